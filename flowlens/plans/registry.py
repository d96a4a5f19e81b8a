"""The registered queries, each beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.plans import fixtures as fx
from flowlens.session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL only its rows are looked at."""

    def add(function: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: without_zone(function(tune(spark), sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def without_zone(df: DataFrame) -> DataFrame:
    """Timestamps as the wall clock of the session, so that no zone enters a comparison."""
    zoned = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else df


def _plain(sql: str, **views: str) -> str:
    names = {t: t for t in fx.TABLES} | views
    return sql.format(**names)


FLOWS_CTE = f"flows AS ({_plain(fx.FLOWS)})"
URLS_CTE = f"urls AS ({_plain(fx.URLS)})"
_LINE_CTES = {
    "kv_lines": (FLOWS_CTE, fx.KV_LINES, "flows"),
    "traffic_lines": (FLOWS_CTE, fx.TRAFFIC_LINES, "flows"),
    "url_lines": (URLS_CTE, fx.URL_LINES, "urls"),
}
FILES_CTE = f"files AS ({_plain(fx.TRACKED_FILES)}), progress AS ({_plain(fx.INGEST_FILES)})"
RECORDS_CTE = f"records AS ({_plain(fx.INGEST_RECORDS)})"

UNIFIED_CTE = """unified AS (
SELECT ts AS timestamp, concat(device_name, ' ', src_ip, ' ', dst_ip) AS raw_message, src_ip, src_port, dst_ip, dst_port,
  action, CAST(protocol AS SMALLINT) AS protocol, bytes_received, bytes_sent, CAST(packets_sent AS BIGINT) AS packets_sent,
  CAST(packets_received AS BIGINT) AS packets_received, CAST(elapsed_time AS BIGINT) AS elapsed_time,
  concat('in', CAST(src_port % 4 AS VARCHAR)) AS src_interface, concat('out', CAST(dst_port % 4 AS VARCHAR)) AS dst_interface,
  rule_name, src_user, src_country, dst_country, log_source, device_name,
  CASE WHEN log_source = 'flows_kv' THEN '' ELSE application END AS application,
  CASE WHEN log_source = 'threats' THEN concat('T', CAST(packets_received AS VARCHAR)) ELSE '' END AS threat_id,
  CASE WHEN log_source = 'threats' THEN rule_name ELSE '' END AS severity, app_category,
  CASE WHEN log_source = 'flows_kv' THEN hostname ELSE application END AS hostname
FROM flows)"""


def _with(ctes: str, sql: str) -> str:
    """SQL after a WITH list; text that starts with a comma adds to the list."""
    sql = sql.strip()
    return f"WITH {ctes}{sql}" if sql.startswith(",") else f"WITH {ctes} {sql}"


def on_flows(sql: str) -> str:
    return _with(FLOWS_CTE, sql)


def on_urls(sql: str) -> str:
    return _with(URLS_CTE, sql)


def on_unified(sql: str) -> str:
    return _with(f"{FLOWS_CTE}, {UNIFIED_CTE}", sql)


def on_lines(name: str, sql: str) -> str:
    """SQL over rendered lines, each beside the row it was rendered from."""
    base, lines, rows = _LINE_CTES[name]
    beside = _plain(lines, flows="flows", urls="urls").replace("AS line", f"AS line, {rows}.*")
    return _with(f"{base}, {name} AS ({beside})", sql)


def on_files(sql: str) -> str:
    return _with(f"{FILES_CTE}, {RECORDS_CTE}", sql)
