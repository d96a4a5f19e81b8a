"""Exact distinct counts that merge: values get dense numbers, and sets of numbers are stored as bitmaps.

A dictionary below `<path>/values/batch=N` gives every value its number, once and for good: values are dealt into buckets by
hash, and each bucket counts on from its last number. Below `<path>/sets/batch=N/ym=M` lies, for each hour or other key, one
bitmap for every 32768 numbers that occur. The distinct count of any stretch of time, or of any group of keys, is the
number of bits in the union of its bitmaps, without the rows. A batch that runs again overwrites its own folders, and must be
the last one then, as in a stream. Nulls are not counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.functions.times import month
from flowlens.operators.filters import TimeWindow
from flowlens.session import path_exists
from flowlens.sources.tables import by_month

# Buckets that values are numbered in, each by itself. Part of the stored format.
BUCKETS = 256
VALUES = "value string, bucket int, n long, batch long"


def _known(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, f"{path}/values"):
        return spark.createDataFrame([], VALUES)
    return spark.read.schema(VALUES).option("basePath", f"{path}/values").parquet(f"{path}/values")


def _number(values: DataFrame, path: str, batch: int) -> DataFrame:
    """Write numbers for values that former batches do not have; returns all."""
    spark = values.sparkSession
    known = _known(spark, path).where(F.col("batch") < batch)
    last = known.groupBy("bucket").agg(F.max("n").alias("last"))
    new = values.distinct().join(known, "value", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("value"), F.lit(BUCKETS)).cast("int"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("value"))
    numbered = new.withColumn("place", place).join(last, "bucket", "left")
    numbered = numbered.select("value", "bucket", (F.coalesce("last", F.lit(0)) + F.col("place")).cast("long").alias("n"))
    numbered.write.mode("overwrite").parquet(f"{path}/values/batch={batch}")
    return _known(spark, path).where(F.col("batch") <= batch)


def add(rows: DataFrame, path: str, keys: dict[str, Column], time: str, column: str, batch: int = 0) -> None:
    """Add the values of a load; `time` names the key that the sets are stored by month of."""
    once = rows.select(*[c.alias(n) for n, c in keys.items()], F.col(column).cast("string").alias("value"))
    once = once.where("value IS NOT NULL").distinct()  # a frequent value is one row a key from here on
    numbers = _number(once.select("value"), path, batch).select("value", ((F.col("n") - 1) * BUCKETS + F.col("bucket") + 1).alias("id"))
    sets = once.join(numbers, "value").groupBy(*keys, F.bitmap_bucket_number("id").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits")
    )
    sets = by_month(sets.withColumn("ym", month(F.col(time))))
    sets.write.mode("overwrite").partitionBy("ym").parquet(f"{path}/sets/batch={batch}")


def stored(spark: SparkSession, path: str, schema: str, time: str, window: TimeWindow | None = None) -> DataFrame:
    """The bitmaps of a window, read from its months; `schema` names the keys and their types."""
    fields = f"{schema}, part long, bits binary, batch long, ym int"
    if not path_exists(spark, f"{path}/sets"):
        return spark.createDataFrame([], fields)
    sets = spark.read.schema(fields).option("basePath", f"{path}/sets").parquet(f"{path}/sets")
    return sets if window is None else sets.where(window.predicate(time, "ym"))


def count(sets: DataFrame, by: list[str] | None = None, name: str = "distinct_values") -> DataFrame:
    """Exact distinct values of each group, or of all."""
    by = by or []
    united = sets.groupBy(*by, "part").agg(F.bitmap_or_agg("bits").alias("bits"))
    return united.groupBy(*by).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias(name))
