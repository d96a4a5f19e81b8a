"""Totals, top lists and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.filters import not_blank

TOP = 10
PANELS = {
    "category": "app_category",
    "host": "hostname",
    "user": "src_user",
    "country": "dst_country",
}


def total_bytes() -> Column:
    return F.sum(F.col("bytes_sent") + F.col("bytes_received")).alias("total_bytes")


def top_flows(df: DataFrame, limit: int = TOP) -> DataFrame:
    """(source, destination, port) by bytes. Partial sums leave one row per key to shuffle."""
    keys = ["src_ip", "dst_ip", "dst_port"]
    sums = df.groupBy(*keys).agg(
        F.sum("bytes_sent").alias("total_sent"),
        F.sum("bytes_received").alias("total_received"),
        total_bytes(),
    )
    return sums.orderBy(F.desc("total_bytes"), *keys).limit(limit)


def top_values(df: DataFrame, column: str, limit: int = TOP) -> DataFrame:
    """Values of one column by number of events; blanks do not count."""
    counts = (
        df.where(not_blank(column))
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("events"), total_bytes())
    )
    return counts.orderBy(F.desc("events"), column).limit(limit)


def summary_panels(df: DataFrame, panels: dict[str, str] = PANELS, limit: int = TOP) -> DataFrame:
    """All top lists of the summary page in one pass over the rows.

    Rows fan out to one per panel only as far as the partial aggregation; the rank filter keeps
    `limit` rows per panel and task before the last shuffle.
    """
    size = (F.col("bytes_sent") + F.col("bytes_received")).alias("size")
    long = df.select(*panels.values(), size).unpivot(
        "size", list(panels.values()), "column", "value"
    )
    counts = (
        long.where(not_blank("value"))
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("events"), F.sum("size").alias("total_bytes"))
    )
    order = Window.partitionBy("column").orderBy(F.desc("events"), "value")
    names = F.create_map(*[F.lit(x) for name, col in panels.items() for x in (col, name)])
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
        .select(names[F.col("column")].alias("panel"), "rank", "value", "events", "total_bytes")
    )


# Values that a sketch of frequent ones tracks.
TRACKED = 10_000


def top_sketches(df: DataFrame, by: list[Column], panels: dict[str, str] = PANELS, tracked: int = TRACKED) -> DataFrame:
    """Sketches of the frequent values of each panel, by hour or the like: rows to store and to combine later.

    A sketch is exact for up to about three quarters of `tracked` distinct values, and of bounded size beyond.
    """
    states = [
        F.call_function("approx_top_k_accumulate", F.when(not_blank(column), F.col(column)), F.lit(tracked)).alias(panel)
        for panel, column in panels.items()
    ]
    return df.groupBy(*by).agg(*states)


def top_from_sketches(states: DataFrame, panels: list[str] | None = None, limit: int = TOP, tracked: int = TRACKED) -> DataFrame:
    """panel, value, events of the most frequent values over all given sketches, without the rows behind them."""
    names = panels or list(PANELS)
    combined = states.agg(*[F.call_function("approx_top_k_combine", F.col(p), F.lit(tracked)).alias(p) for p in names])
    tops = F.array(*[
        F.struct(F.lit(p).alias("panel"), F.call_function("approx_top_k_estimate", F.col(p), F.lit(limit)).alias("top")) for p in names
    ])
    each = combined.select(F.inline(tops)).select("panel", F.explode("top").alias("x"))
    return each.select("panel", F.col("x.item").alias("value"), F.col("x.count").alias("events"))


def summary_totals(df: DataFrame) -> DataFrame:
    """Events, bytes and distinct sources of the window; 0 where there are none."""
    return df.agg(
        F.count(F.lit(1)).alias("total_connections"),
        F.coalesce(F.sum(F.col("bytes_sent") + F.col("bytes_received")), F.lit(0)).alias("total_bytes"),
        F.countDistinct("src_ip").alias("active_ips"),
    )


def facet(df: DataFrame, column: str, keep_blank: bool = True) -> DataFrame:
    """Sorted distinct values of one column."""
    rows = df if keep_blank else df.where(not_blank(column))
    return rows.select(column).distinct().orderBy(column)


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct non-blank values of several columns in one pass, as (facet, value)."""
    long = df.select(*columns).unpivot([], columns, "facet", "value")
    return long.where(not_blank("value")).distinct().orderBy("facet", "value")


def count_by_source(df: DataFrame) -> DataFrame:
    return df.groupBy("log_source").agg(F.count(F.lit(1)).alias("events"))
