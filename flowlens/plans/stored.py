"""Queries on a stored table with a page directory and indexes, all written once for each session."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import verify
from flowlens.operators.filters import FilterSpec
from flowlens.plans import fixtures as fx
from flowlens.plans.pages import FLOW_ORDER_SQL
from flowlens.plans.registry import on_flows, query
from flowlens.session import scratch_dir, shuffles_dropped, tasks_for
from flowlens.sources import directory, indexes, tables

ORDER = ["ts", "src_ip", "dst_ip"]
LOOKED_UP = ["src_user", "src_ip", "hostname", "dst_port"]


@dataclass(frozen=True)
class Stored:
    root: str
    rows: DataFrame

    @property
    def values(self) -> DataFrame:
        return self.rows.sparkSession.read.schema(indexes.VALUE_INDEX).parquet(f"{self.root}/values")

    @property
    def grams(self) -> DataFrame:
        return self.rows.sparkSession.read.schema(indexes.GRAM_INDEX).parquet(f"{self.root}/grams")


_STORED: dict[tuple[str, str], Stored] = {}


def stored_flows(spark: SparkSession, sf_dir: str) -> Stored:
    """The flows as a clustered table by month, its page directory and its indexes."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        root = scratch_dir(spark, "stored")
        tables.write_clustered(fx.flow_rounds(spark, sf_dir), f"{root}/flows", ORDER, "ts")
        rows = spark.read.parquet(f"{root}/flows")
        with tasks_for(spark, rows.count()), shuffles_dropped(spark):
            directory.add(rows, f"{root}/directory", "ts")
            indexes.value_index(rows, LOOKED_UP).write.parquet(f"{root}/values")
            indexes.gram_index(rows, list(FilterSpec.SEARCHED), "ts").write.parquet(f"{root}/grams")
        _STORED[key] = Stored(root, rows)
    return _STORED[key]


def _page(spark, sf_dir, number: int) -> DataFrame:
    stored = stored_flows(spark, sf_dir)
    return directory.page(stored.rows, f"{stored.root}/directory", number, ts="ts")


@query("logs_page", on_flows(f"SELECT * FROM flows ORDER BY {FLOW_ORDER_SQL} LIMIT 50 OFFSET 100"))
def logs_page(spark, sf_dir):
    """Page 3 of the stored table, by its directory."""
    return _page(spark, sf_dir, 3)


@query("logs_page_deep", on_flows(f"SELECT * FROM flows ORDER BY {FLOW_ORDER_SQL} LIMIT 50 OFFSET 4950"))
def logs_page_deep(spark, sf_dir):
    """Page 100, the same way."""
    return _page(spark, sf_dir, 100)


# One user: the last by name, so that no other name holds it.
_USER = "(SELECT max(src_user) FROM flows)"


def _last_user(rows: DataFrame) -> str:
    return rows.agg(F.max("src_user").alias("u")).first()["u"]


@query("search_indexed", on_flows(f"""
SELECT *, true AS fewer_bytes FROM flows WHERE {" OR ".join(f"contains(lower({c}), lower({_USER}))" for c in FilterSpec.SEARCHED)}"""))
def search_indexed(spark, sf_dir):
    """A text in any of the searched columns, any case: only files that have all its grams are read."""
    stored = stored_flows(spark, sf_dir)
    needle = _last_user(stored.rows).upper()
    found = indexes.search(stored.rows, f"{stored.root}/flows", stored.grams, needle, list(FilterSpec.SEARCHED), "ts")
    files, _ = indexes.files_like(stored.rows, stored.grams, needle, "ts")
    sizes = indexes.table_files(stored.rows)
    fewer = sum(sizes[f] for f in files) < sum(sizes.values())
    return found.drop("ym").withColumn("fewer_bytes", F.lit(fewer))


@query("lookup_indexed", on_flows(f"""
SELECT *, true AS fewer_files FROM flows WHERE src_user = {_USER} AND dst_port = 443"""))
def lookup_indexed(spark, sf_dir):
    """Rows of one user and port: only files whose values, bounds or bitmaps can hold both are listed."""
    stored = stored_flows(spark, sf_dir)
    equal = {"src_user": _last_user(stored.rows), "dst_port": 443}
    found = indexes.look_up(stored.rows, f"{stored.root}/flows", stored.values, equal)
    fewer = len(indexes.files_with(stored.rows, stored.values, equal)) < len(stored.rows.inputFiles())
    return found.drop("ym").withColumn("fewer_files", F.lit(fewer))


# --- verification of content ------------------------------------------------------------------

VERIFIED = ["ts", "src_ip", "src_port", "dst_ip", "dst_port", "bytes_sent"]
_LOST, _TWICE, _CHANGED = "src_port % 97 = 3", "src_port % 101 = 5", "src_port % 103 = 7"


@query("verify_content", on_flows(f"""
, parsed AS (SELECT concat(device_name, '.log') AS file, {', '.join(VERIFIED)} FROM flows),
stored AS (
  SELECT file, ts, src_ip, src_port, dst_ip, dst_port, CASE WHEN {_CHANGED} THEN bytes_sent + 1 ELSE bytes_sent END AS bytes_sent
  FROM parsed WHERE NOT ({_LOST}) UNION ALL SELECT * FROM parsed WHERE {_TWICE} AND NOT ({_LOST}) AND NOT ({_CHANGED}))
SELECT file, {', '.join(VERIFIED)}, CAST(sum(p) AS BIGINT) AS parsed_copies, CAST(sum(s) AS BIGINT) AS stored_copies,
  CASE WHEN sum(s) = 0 THEN 'lost' WHEN sum(p) = 0 THEN 'foreign' WHEN sum(s) < sum(p) THEN 'copies lost' ELSE 'repeated' END AS finding
FROM (SELECT *, 1 AS p, 0 AS s FROM parsed UNION ALL SELECT *, 0, 1 FROM stored)
GROUP BY file, {', '.join(VERIFIED)} HAVING sum(p) <> sum(s)"""))
def verify_content(spark, sf_dir):
    """Rows that a load lost, stored twice or changed, named by comparing checksums first."""
    path = f"{scratch_dir(spark, 'verified')}/parsed"
    # Written once: the comparison reads both sides several times, and each read would join the given tables again.
    fx.flows(spark, sf_dir).select(F.concat("device_name", F.lit(".log")).alias("file"), *VERIFIED).write.parquet(path)
    parsed = spark.read.parquet(path)
    changed = F.when(F.expr(_CHANGED), F.col("bytes_sent") + 1).otherwise(F.col("bytes_sent"))
    stored = parsed.where(f"NOT ({_LOST})").withColumn("bytes_sent", changed)
    stored = stored.unionByName(parsed.where(f"{_TWICE} AND NOT ({_LOST}) AND NOT ({_CHANGED})"))
    return verify.differences(parsed, stored, "file", VERIFIED)
