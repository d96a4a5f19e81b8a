"""The registry of processed files, and inventories of folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The keys of a registry document, as the files have them.
FILE_INFO = (
    "filepath: STRING, size: BIGINT, last_modified: DOUBLE, last_processed_position: BIGINT,"
    " last_processed_time: DOUBLE, rotated_files: ARRAY<STRING>, total_lines_processed: BIGINT,"
    " total_bytes_processed: BIGINT, clickhouse_verified: BOOLEAN"
)
RECORD = (
    "original_file: STRING, rotated_file: STRING, start_position: BIGINT, end_position: BIGINT,"
    " lines_processed: BIGINT, bytes_processed: BIGINT, processing_start_time: DOUBLE,"
    " processing_end_time: DOUBLE, clickhouse_verification_time: DOUBLE, safe_to_delete: BOOLEAN"
)
REGISTRY = (
    f"file_info MAP<STRING, STRUCT<{FILE_INFO}>>, processed_records ARRAY<STRUCT<{RECORD}>>,"
    " last_updated DOUBLE"
)


def read_registry(spark: SparkSession, path: str, one_document_per_line: bool = False) -> DataFrame:
    """Registry documents with a fixed schema. A pretty-printed document spans lines; many small
    documents, one per line, split over tasks."""
    reader = spark.read.schema(REGISTRY)
    return (reader if one_document_per_line else reader.option("multiLine", "true")).json(path)


def _time(seconds: str):
    """Epoch seconds as a timestamp; 0 stands for never."""
    return F.when(F.col(seconds) > 0, F.timestamp_seconds(seconds))


def file_progress(registry: DataFrame) -> DataFrame:
    """One row per tracked file."""
    rows = registry.select(F.explode("file_info").alias("path", "info")).select("path", "info.*")
    return rows.select(
        "path",
        "size",
        F.col("last_processed_position").alias("position"),
        F.col("total_lines_processed").alias("total_lines"),
        F.col("total_bytes_processed").alias("total_bytes"),
        F.size("rotated_files").alias("rotated_files"),
        F.col("clickhouse_verified").alias("verified"),
        _time("last_modified").alias("modified"),
        _time("last_processed_time").alias("processed_at"),
    )


def processed_records(registry: DataFrame) -> DataFrame:
    """One row per rotated file."""
    rows = registry.select(F.explode("processed_records").alias("r")).select("r.*")
    return rows.select(
        "original_file",
        "rotated_file",
        "start_position",
        "end_position",
        "lines_processed",
        "bytes_processed",
        _time("processing_start_time").alias("processing_start_time"),
        _time("processing_end_time").alias("processing_end_time"),
        _time("clickhouse_verification_time").alias("verified_at"),
        "safe_to_delete",
    )


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, size, modified) of the files below a folder; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(path)
    )
    return files.select(
        "path",
        F.substring_index("path", "/", -1).alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    )


def file_inventory(files: DataFrame, extension: str = "log") -> DataFrame:
    """Per log file: its size and time, and how many rotated pieces `<file>.<time>[.gz]` it has."""
    base = F.regexp_extract("name", rf"^(.*?\.{extension})", 1)
    own = F.col("name") == F.col("base")
    return (
        files.withColumn("base", base)
        .where(F.col("base") != "")
        .groupBy("base")
        .agg(
            F.max(own).alias("file_exists"),
            F.coalesce(F.max(F.when(own, F.col("size"))), F.lit(0)).alias("size"),
            F.max(F.when(own, F.col("modified"))).alias("modified"),
            F.count_if(~own).alias("rotated_files"),
            F.sum("size").alias("total_size"),
        )
    )
