"""Indexes over the files of a log table: a look-up reads only files that can hold what it asks for.

- A value index has, for each file and column, the least and the largest value as text, the values themselves while
  there are few, and else a bitmap of hashed values.
- A gram index has, for every three characters in a row that occur in the searched columns, in lower case, the files and
  the time between which they occur there.

An index only says where rows may be; rows are checked by the predicate itself. Files that it does not know are read, so
it may lag behind its table. Files are added, never changed; an index of the files of one load is added to the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators.filters import any_contains

GRAM = 3
# Values of a column that a file's entry lists; with more it has a bitmap of so many bits.
VALUES, BITS = 64, 32768

VALUE_INDEX = "file string, column string, n long, low string, high string, bits binary, listed array<string>"
GRAM_INDEX = "gram string, file string, since timestamp_ntz, until timestamp_ntz"


def _file() -> Column:
    return F.col("_metadata.file_path")


def _file_id() -> Column:
    """Eight bytes for a path, which is longer than most values. Were two alike, both files' entries would cover both."""
    return F.xxhash64(_file())


def _named(index: DataFrame, table: DataFrame) -> DataFrame:
    """Paths instead of ids."""
    files = table.select(_file().alias("file")).distinct()
    return index.join(files.withColumn("id", F.xxhash64("file")), "id").drop("id")


def table_files(table: DataFrame) -> dict[str, int]:
    """Files of a table and their sizes, from the listing that a scan starts from."""
    spark = table.sparkSession
    paths = table.inputFiles()
    if not paths:
        return {}
    listed = {_plain(r["path"]): r["length"] for r in spark.read.format("binaryFile").load(paths).select("path", "length").collect()}
    return {path: listed[_plain(path)] for path in paths}


def _read(table: DataFrame, root: str, files: list[str]) -> DataFrame:
    spark = table.sparkSession
    if not files:
        return spark.createDataFrame([], table.schema)
    return spark.read.schema(table.schema).option("basePath", root).parquet(*files)


# --- values ---


def _bit(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(BITS))


def value_index(table: DataFrame, columns: list[str]) -> DataFrame:
    """VALUE_INDEX of the files of a table."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    rows = table.select(_file_id().alias("id"), F.inline(each)).where("value IS NOT NULL")
    once = rows.distinct()  # values repeat much within a file, so few rows are left to shuffle
    stats = once.groupBy("id", "column").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.bitmap_construct_agg(_bit(F.col("value"))).alias("bits"),
    )
    few = once.join(stats.where(F.col("n") <= VALUES).select("id", "column"), ["id", "column"], "left_semi")
    listed = few.groupBy("id", "column").agg(F.sort_array(F.collect_set("value")).alias("listed"))
    bits = F.when(F.col("listed").isNull(), F.col("bits")).alias("bits")
    found = stats.join(listed, ["id", "column"], "left").select("id", "column", "n", "low", "high", bits, "listed")
    return _named(found, table).select("file", "column", "n", "low", "high", "bits", "listed")


def _may_hold(value: Column) -> Column:
    place = _bit(value).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    in_bits = F.getbit(byte, place % 8) == 1
    inside = (F.col("low") <= value) & (value <= F.col("high"))
    return inside & F.when(F.col("listed").isNotNull(), F.array_contains("listed", value)).otherwise(in_bits)


def files_with(table: DataFrame, index: DataFrame, equal: dict[str, object]) -> list[str]:
    """Files of the table that can have rows with these values."""
    asked = F.lit(False)
    for column, value in equal.items():
        asked |= (F.col("column") == column) & _may_hold(F.lit(str(value)))
    names = list(equal)
    entries = index.where(F.col("column").isin(names)).groupBy("file").agg(
        F.count_if(asked).alias("fits"), F.count(F.lit(1)).alias("known")
    )
    gone = {r["file"] for r in entries.where((F.col("known") == len(names)) & (F.col("fits") < len(names))).collect()}
    return [f for f in table.inputFiles() if _plain(f) not in {_plain(g) for g in gone}]


def look_up(table: DataFrame, root: str, index: DataFrame, equal: dict[str, object]) -> DataFrame:
    """Rows of a table below `root` with these values, read from the files that can have them."""
    rows = _read(table, root, files_with(table, index, equal))
    for column, value in equal.items():
        rows = rows.where(F.col(column) == F.lit(value))
    return rows


def _plain(path: str) -> str:
    """file:/x and file:///x are one path."""
    scheme, _, rest = path.partition(":")
    return f"{scheme}:/{rest.lstrip('/')}" if rest.startswith("/") and scheme == "file" else path


# --- grams ---


def _grams(value: Column) -> Column:
    """Distinct runs of GRAM characters, none in a shorter text, and the empty one, which names all files known."""
    places = F.sequence(F.lit(1), F.length(value) - (GRAM - 1))
    runs = F.array_distinct(F.transform(places, lambda i: F.substring(value, i, F.lit(GRAM))))
    return F.concat(F.array(F.lit("")), F.when(F.length(value) >= GRAM, runs).otherwise(F.array().cast("array<string>")))


def gram_index(table: DataFrame, columns: list[str], ts: str) -> DataFrame:
    """GRAM_INDEX of the files of a table, by gram, so that a look-up reads few row groups of it."""
    when = F.col(ts).cast("timestamp_ntz")
    values = F.array(*[F.col(c).cast("string") for c in columns])
    rows = table.select(_file_id().alias("id"), when.alias("ts"), F.explode(values).alias("value")).where("value IS NOT NULL")
    first, last = F.min("since").alias("since"), F.max("until").alias("until")
    once = rows.groupBy("id", "value").agg(F.min("ts").alias("since"), F.max("ts").alias("until"), F.count_if(F.col("ts").isNull()).alias("open"))
    # Rows without a time may be anywhere.
    once = once.select("id", "value", *[F.when(F.col("open") == 0, F.col(c)).alias(c) for c in ("since", "until")])
    runs = once.select("id", F.explode(_grams(F.lower("value"))).alias("gram"), "since", "until")
    some = F.count_if(F.col("since").isNull()).alias("open")
    found = runs.groupBy("gram", "id").agg(first, last, some)
    found = found.select("gram", "id", *[F.when(F.col("open") == 0, F.col(c)).alias(c) for c in ("since", "until")])
    found = _named(found, table).select("gram", "file", "since", "until")
    return found.repartitionByRange("gram", "file").sortWithinPartitions("gram", "file")


def files_like(table: DataFrame, index: DataFrame, needle: str, ts: str) -> tuple[list[str], Column]:
    """Files of the table that can have the text in a searched column, and a bound on the time of such rows."""
    spark = table.sparkSession
    grams = spark.range(1).select(_grams(F.lower(F.lit(needle))).alias("g")).first()["g"]
    entries = index.where(F.col("gram").isin(grams)).groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.max("since").alias("since"), F.min("until").alias("until"),
        F.count_if(F.col("since").isNull()).alias("open"),
    )
    known = {_plain(r["file"]): r for r in entries.collect()}  # one row a file
    fits = [r for r in known.values() if r["n"] == len(grams) and (r["open"] or r["since"] <= r["until"])]
    held = {_plain(r["file"]) for r in fits}
    files = [f for f in table.inputFiles() if _plain(f) in held or _plain(f) not in known]
    if not held or len(grams) == 1 or any(r["open"] for r in fits) or any(_plain(f) not in known for f in files):
        return files, F.lit(True)
    since, until = (F.lit(str(x)).cast("timestamp_ntz") for x in (min(r["since"] for r in fits), max(r["until"] for r in fits)))
    return files, F.col(ts).between(since, until)


def search(
    table: DataFrame, root: str, index: DataFrame, needle: str, columns: list[str], ts: str, ignore_case: bool = True
) -> DataFrame:
    """Rows of a table below `root` with the text in any of the columns, read from the files that can have it."""
    files, bound = files_like(table, index, needle, ts)
    return _read(table, root, files).where(bound).where(any_contains(columns, needle, ignore_case))
