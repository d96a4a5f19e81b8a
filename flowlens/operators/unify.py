"""One stream of log rows from sources with different column names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.schemas import SOURCES, UNIFIED, UNIFIED_SCHEMA


def unify_project(df: DataFrame, source: str) -> DataFrame:
    """Rows of one source in the unified columns; columns the source lacks are filled blank."""
    place = 1 + SOURCES.index(source)
    types = {f.name: f.dataType for f in UNIFIED_SCHEMA}

    def fill(row: tuple[str, ...]) -> Column:
        name, origin = row[0], row[place]
        if origin.startswith("'"):
            return F.lit(origin.strip("'"))
        if origin not in df.columns:
            return F.lit("")
        # an event time may come with or without a zone and stays as it is
        return F.col(origin) if name == "timestamp" else F.col(origin).cast(types[name])

    return df.select(*[fill(row).alias(row[0]) for row in UNIFIED])


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """UNION ALL of the given sources. A later filter on `log_source` drops whole branches."""
    unified = [unify_project(df, name) for name, df in frames.items()]
    return reduce(DataFrame.unionByName, unified)


def union_available(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """The union of those sources whose table exists; an empty frame when none does."""
    found = {s: spark.table(t) for s, t in tables.items() if spark.catalog.tableExists(t)}
    return union_sources(found) if found else spark.createDataFrame([], UNIFIED_SCHEMA)
