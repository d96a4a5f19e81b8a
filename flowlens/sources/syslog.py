"""Log lines from files.

Files are read whole and once: a landing folder of closed files takes the place of a growing file.
A stream's checkpoint is its position.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE_SCHEMA = T.StructType([T.StructField("value", T.StringType())])


def _lines(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("file_time"),
    )


def read_syslog(spark: SparkSession, path: str, since: datetime | None = None) -> DataFrame:
    """(line, file, file_time) of all files, or of those changed after `since`.

    The bound on the file time is a metadata filter: older files are not opened.
    """
    lines = _lines(spark.read.schema(LINE_SCHEMA).option("recursiveFileLookup", "true").text(path))
    return lines if since is None else lines.where(F.col("file_time") > F.lit(since))


def read_rotated(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Lines of gzip archives. One task reads one archive, as gzip cannot be split; with fewer
    archives than cores, `partitions` spreads the lines before they are parsed."""
    lines = _lines(
        spark.read.schema(LINE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.gz")
        .text(path)
    )
    return lines if partitions is None else lines.repartition(partitions)


def stream_syslog(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The lines of files as they appear in the folder."""
    reader = spark.readStream.schema(LINE_SCHEMA).option("recursiveFileLookup", "true")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _lines(reader.text(path))
