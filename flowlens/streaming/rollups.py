"""Rollups that grow with every batch of rows, stored by month.

Below its path a store has

- `pending/batch_id=N/ym=M`: partial states of micro-batch N that fall into month M;
- `merged/ym=M/upto=N`: the states of month M of all batches up to N, one row a key.

The newest version of a month stands for the batches up to its number; later batches are read besides it. A compaction
writes a new version of the months that later batches touch, and of no others, then removes what it replaces. Until
that version is complete the former one counts, so a run that fails or is repeated loses and doubles nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flowlens.functions.times import month
from flowlens.operators.filters import TimeWindow
from flowlens.operators.rollups import Rollup
from flowlens.session import folders, remove
from flowlens.sources.tables import RETENTION_DAYS, by_month

# Each batch makes a folder of small files until it is compacted.
TRIGGER = {"processingTime": "10 seconds"}


@dataclass(frozen=True)
class Store:
    """Where a rollup lies; `time` names its key of hours or days, `rows` is the schema of what it sums up."""

    path: str
    rollup: Rollup
    time: str
    rows: T.StructType

    def schema(self, spark: SparkSession) -> T.StructType:
        return self.rollup.partial(spark.createDataFrame([], self.rows)).schema


def store_partials(stream: DataFrame, store: Store, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each batch adds its partial states to the table; no state is held between batches.

    A late row makes one more partial state of its hour, so nothing is dropped. A batch that runs
    again overwrites its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        states = store.rollup.partial(batch).withColumn("ym", month(F.col(store.time)))
        by_month(states).write.mode("overwrite").partitionBy("ym").parquet(f"{store.path}/pending/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or TRIGGER))
        .start()
    )


@dataclass(frozen=True)
class Listing:
    """The newest version of each month, and batches behind it as (batch, month)."""

    merged: dict[int, int]
    pending: list[tuple[int, int]]
    replaced: list[str]

    def paths(self, root: str, months: set[int] | None = None) -> list[str]:
        kept = [f"{root}/merged/ym={m}/upto={n}" for m, n in sorted(self.merged.items()) if months is None or m in months]
        return kept + [f"{root}/pending/batch_id={n}/ym={m}" for n, m in self.pending if months is None or m in months]


def listing(spark: SparkSession, root: str) -> Listing:
    """What lies below a store's path. Batches count once their write is complete."""
    versions = [(f["ym"], f["upto"]) for f in folders(spark, f"{root}/merged/ym=*/upto=*")]
    merged = {m: max(n for k, n in versions if k == m) for m in {m for m, _ in versions}}
    replaced = [f"{root}/merged/ym={m}/upto={n}" for m, n in versions if n < merged[m]]
    complete = {f["batch_id"] for f in folders(spark, f"{root}/pending/batch_id=*/_SUCCESS")}
    batches = [(f["batch_id"], f["ym"]) for f in folders(spark, f"{root}/pending/batch_id=*/ym=*")]
    replaced += [f"{root}/pending/batch_id={n}/ym={m}" for n, m in batches if n <= merged.get(m, -1)]
    pending = sorted((n, m) for n, m in batches if n in complete and n > merged.get(m, -1))
    return Listing(merged, pending, replaced)


def _months(found: Listing, window: TimeWindow | None) -> set[int] | None:
    if window is None:
        return None
    low = window.since.year * 100 + window.since.month
    high = window.until.year * 100 + window.until.month if window.until else 10**6
    return {m for m in [*found.merged, *(m for _, m in found.pending)] if low <= m <= high}


def states(spark: SparkSession, store: Store, window: TimeWindow | None = None) -> DataFrame:
    """Stored states, of a window of the time key if one is given: the folders of other months are not listed."""
    found = listing(spark, store.path)
    paths = found.paths(store.path, _months(found, window))
    schema = store.schema(spark)
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return rows if window is None else rows.where(window.predicate(store.time))


def read_rollup(spark: SparkSession, store: Store, window: TimeWindow | None = None) -> DataFrame:
    """Merge the partial states and turn them into numbers."""
    return store.rollup.finish(store.rollup.merge(states(spark, store, window)))


def compact(spark: SparkSession, store: Store) -> list[int]:
    """Merge pending batches into new versions of the months they touch; returns these months."""
    found = listing(spark, store.path)
    touched = {m for _, m in found.pending}
    if touched:
        upto = max(n for n, _ in found.pending)
        rows = spark.read.schema(store.schema(spark)).parquet(*found.paths(store.path, touched))
        merged = store.rollup.merge(rows).withColumns({"ym": month(F.col(store.time)), "upto": F.lit(upto)})
        by_month(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ym", "upto").parquet(
            f"{store.path}/merged"
        )
    for path in listing(spark, store.path).replaced:
        remove(spark, path)
    return sorted(touched)


def expire(spark: SparkSession, store: Store, as_of: datetime, days: int = RETENTION_DAYS) -> list[int]:
    """Remove the months that end before the retention time; what is left of the month it falls in is
    cut by the window of a read."""
    limit = as_of - timedelta(days=days)
    found = listing(spark, store.path)
    gone = {m for m in [*found.merged, *(m for _, m in found.pending)] if m < limit.year * 100 + limit.month}
    for path in found.paths(store.path, gone) if gone else ():
        remove(spark, path)
    return sorted(gone)


def hourly_watermarked(stream: DataFrame, ts: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Hourly counts with bounded state: hours close after `delay`, later rows are dropped."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return (
        timed.groupBy(F.window(ts, "1 hour").alias("w"), *keys)
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.sum("bytes_sent").alias("total_bytes_sent"),
            F.approx_count_distinct("source_address").alias("unique_users"),
        )
        .select(F.col("w.start").alias("hour"), *keys, "requests", "total_bytes_sent", "unique_users")
    )
