"""Connected components by alternating large-star and small-star steps, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import land


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: each node of an edge beside the smallest node that it is connected with."""
    small = edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    ).distinct()
    small = land(small, "edges")
    mark = _mark(small)
    while mark[0]:
        both = small.unionByName(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = land(small.unionByName(joined.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _mark(small)
        if now == mark:
            break
        mark = now
    roots = small.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(small.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
