"""Sorted pages. Whatever its depth, no more than a page passes through one task or the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.session import ensure_checkpoint_dir

PAGE_SIZE = 50


def latest_rows(df: DataFrame, limit: int, ts: str = "timestamp") -> DataFrame:
    """Newest rows; the other columns break ties."""
    return df.orderBy(*newest_first(df, ts)).limit(limit)


def newest_first(df: DataFrame, ts: str = "timestamp") -> list[Column]:
    return [F.desc(ts), *[F.asc(c) for c in df.columns if c != ts]]


def page(df: DataFrame, order: list[Column], number: int, size: int = PAGE_SIZE) -> DataFrame:
    """Page `number` (from 1) of the frame in that order."""
    return _Ranked(df, order).rows((max(number, 1) - 1) * size, size)


# Rows that one task may sort for a page; a deeper place within a second is found by ranges.
SORTED = 10_000


def newest_page(df: DataFrame, number: int, size: int = PAGE_SIZE, ts: str = "timestamp") -> DataFrame:
    """Page `number` of the rows, newest first and rows without a time last, at any depth.

    Counts per hour and then per second (small, and aggregated on the executors) tell which time
    the page lies in, and only that time is sorted. A stored table has these counts in its page directory.
    """
    order, skip = newest_first(df, ts), (max(number, 1) - 1) * size
    for unit in ("HOUR", "SECOND"):
        df, skip = _narrow(df, F.date_trunc(unit, F.col(ts)), skip, size)
    return sorted_rows(df, order, skip, size)


def sorted_rows(df: DataFrame, order: list[Column], skip: int, size: int) -> DataFrame:
    """Rows skip+1..skip+size in that order."""
    if skip + size <= SORTED:
        return df.orderBy(*order).offset(skip).limit(size)
    return _Ranked(df, order).rows(skip, size)


def held(counts: list, skip: int, size: int) -> tuple | None:
    """The newest and the oldest bucket of (bucket, rows) that hold rows skip+1..skip+size, None as the oldest of all,
    and the rows to skip in them; None if there are none."""
    before, found, inner_skip = 0, [], 0
    known = sorted((c for c in counts if c[0] is not None), key=lambda c: c[0], reverse=True)
    for bucket, n in [*known, *(c for c in counts if c[0] is None)]:
        if before + n > skip:
            if not found:
                inner_skip = skip - before
            found = [found[0] if found else bucket, bucket]
        before += n
        if before >= skip + size:
            break
    return (*found, inner_skip) if found else None


def _narrow(df: DataFrame, bucket: Column, skip: int, size: int) -> tuple[DataFrame, int]:
    """The buckets that hold rows skip+1..skip+size, and how many rows to skip within them."""
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    found = held(counts.collect(), skip, size)  # one row per hour, or per second of the hours left
    if found is None:
        return df.where(F.lit(False)), 0
    newest, oldest, inner_skip = found
    if newest is None:
        return df.where(bucket.isNull()), inner_skip
    if oldest is None:
        return df.where((bucket <= F.lit(newest)) | bucket.isNull()), inner_skip
    return df.where(bucket.between(F.lit(oldest), F.lit(newest))), inner_skip


class _Ranked:
    """A frame in order, any stretch of which can be taken without passing rows through one task.

    The range-partitioned rows are checkpointed, since range bounds are sampled anew on every run;
    the row counts per partition then place each partition.
    """

    def __init__(self, df: DataFrame, order: list[Column]):
        ensure_checkpoint_dir(df.sparkSession)
        self.sorted = (
            df.repartitionByRange(*order)
            .sortWithinPartitions(*order)
            .withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
            .checkpoint()
        )
        counts = self.sorted.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("first"))
        self.parts = counts.orderBy("_part").collect()  # one row per partition
        self.total = sum(row["n"] for row in self.parts)

    def rows(self, skip: int, size: int) -> DataFrame:
        wanted, before = F.lit(False), 0
        for row in self.parts:
            low, high = max(skip - before, 0), min(skip + size - before, row["n"])
            if low < high:
                place = F.col("_row") - row["first"]
                wanted |= (F.col("_part") == row["_part"]) & (place >= low) & (place < high)
            before += row["n"]
        return self.sorted.where(wanted).orderBy("_row").drop("_part", "_row")


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    number: int
    total_pages: int
    total_rows: int


def clamped_page(df: DataFrame, order: list[Column], number: int, size: int = PAGE_SIZE) -> Page:
    """A page with its totals; a number beyond the last page gives the last, below 1 the first.

    The frame is computed once, for the totals and the page.
    """
    ranked = _Ranked(df, order)
    pages = max(-(-ranked.total // size), 1)
    number = min(max(number, 1), pages)
    return Page(ranked.rows((number - 1) * size, size), number, pages, ranked.total)
