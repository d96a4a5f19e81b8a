"""A page directory: how many rows a log table has in each hour and each second, kept beside the table.

Every load adds its counts below `<path>/seconds/batch=N/ym=M` and `<path>/hours/batch=N`; a load that runs again
overwrites its own. Counts of one hour from several loads add up. A page, however deep, is found from the counts of
hours, then from the seconds of the few hours it lies in, and read as one range of time from the months it lies in.
Rows without a time are counted, too, and come last.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.times import month
from flowlens.operators.paging import PAGE_SIZE, held, newest_first, sorted_rows
from flowlens.session import path_exists
from flowlens.sources.tables import by_month

HOURS = "hour timestamp_ntz, n long"
SECONDS = "second timestamp_ntz, n long, batch long, ym int"


def _unit(name: str, ts: str | Column) -> Column:
    return F.date_trunc(name, ts).cast("timestamp_ntz")


def add(rows: DataFrame, path: str, ts: str = "timestamp", batch: int = 0) -> None:
    """Add the counts of a load. The rows are read once; hours are summed up from the seconds written. The seconds of a month
    are shuffled into few files, as else each task would write one for every month."""
    spark = rows.sparkSession
    seconds = rows.groupBy(_unit("SECOND", ts).alias("second")).agg(F.count(F.lit(1)).alias("n"))
    target = f"{path}/seconds/batch={batch}"
    seconds = by_month(seconds.withColumn("ym", F.coalesce(month(F.col("second")), F.lit(0))))
    seconds.write.mode("overwrite").partitionBy("ym").parquet(target)
    written = spark.read.schema("second timestamp_ntz, n long, ym int").parquet(target)
    hours = written.groupBy(_unit("HOUR", "second").alias("hour")).agg(F.sum("n").alias("n"))
    hours.write.mode("overwrite").parquet(f"{path}/hours/batch={batch}")


@dataclass(frozen=True)
class Place:
    """The seconds that hold a page, newest first (None: rows without a time), and the rows to skip in them."""

    newest: datetime | None
    oldest: datetime | None
    skip: int

    def predicate(self, ts: str, ym: str | None = None) -> Column:
        low = F.lit(True) if self.oldest is None else F.col(ts) >= F.lit(str(self.oldest)).cast("timestamp_ntz")
        if self.newest is None:
            return F.col(ts).isNull()
        high = F.col(ts) < F.lit(str(self.newest + timedelta(seconds=1))).cast("timestamp_ntz")
        inside = low & high
        if ym is not None:
            inside &= F.col(ym) <= self.newest.year * 100 + self.newest.month
            if self.oldest is not None:
                inside &= F.col(ym) >= self.oldest.year * 100 + self.oldest.month
        return inside if self.oldest is not None else inside | F.col(ts).isNull()


def find(spark: SparkSession, path: str, number: int, size: int = PAGE_SIZE) -> Place | None:
    """Where page `number` (from 1) lies; None if there is no such page."""
    if not path_exists(spark, f"{path}/hours"):
        return None
    skip = (max(number, 1) - 1) * size
    hours = spark.read.schema(HOURS).parquet(f"{path}/hours")
    found = held(hours.groupBy("hour").agg(F.sum("n").alias("n")).collect(), skip, size)  # as many rows as hours
    if found is None:
        return None
    newest, oldest, skip = found
    whole = Place(newest and newest + timedelta(minutes=59, seconds=59), oldest, skip)
    seconds = spark.read.schema(SECONDS).option("basePath", f"{path}/seconds").parquet(f"{path}/seconds")
    if newest is None:
        seconds = seconds.where("ym = 0")
    elif oldest is None:
        seconds = seconds.where(whole.predicate("second"))
    else:
        seconds = seconds.where(whole.predicate("second", "ym"))
    found = held(seconds.groupBy("second").agg(F.sum("n").alias("n")).collect(), skip, size)  # of the page's hours
    return found and Place(*found)


def page(table: DataFrame, path: str, number: int, size: int = PAGE_SIZE, ts: str = "timestamp", ym: str = "ym") -> DataFrame:
    """Page `number` of a table by month, newest first, by one read of its range."""
    place = find(table.sparkSession, path, number, size)
    if place is None:
        return table.drop(ym).where(F.lit(False))
    rows = table.where(place.predicate(ts, ym if place.oldest is not None else None)).drop(ym)
    return sorted_rows(rows, newest_first(rows, ts), place.skip, size)
