"""Activity of sources as a stream: sessions that end after a time without a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.monitor import ACTIVE_SECONDS


def sessions(stream: DataFrame, ts: str, source: str, gap_seconds: int = ACTIVE_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """source, first_seen, last_seen, events of each stretch of rows less than the gap apart.

    A session comes out once it has ended `delay` before the newest time; until then it is state, so the state is as
    large as the sources that are active. Rows that come later than that are dropped.
    """
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    window = F.session_window(ts, f"{gap_seconds} seconds").alias("session")
    return (
        timed.groupBy(window, source)
        .agg(F.count(F.lit(1)).alias("events"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))
        .select(source, "first_seen", "last_seen", "events")
    )
