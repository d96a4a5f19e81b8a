"""Queries on the health of the ingest, and on the log tables as files."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators import monitor
from flowlens.plans import fixtures as fx
from flowlens.plans.pages import FLOW_ORDER_SQL, page_label_sql
from flowlens.plans.registry import on_files, on_flows, on_lines, on_urls, query
from flowlens.session import scratch_dir
from flowlens.sources import registry, syslog, tables

AS_OF = f"TIMESTAMP '{fx.AS_OF}'"
# Devices are approved up to FW-5; a day without logs makes one inactive.
APPROVED = [f"FW-{i}" for i in range(6)]
ACTIVE_SECONDS = 24 * 3600

# --- files, lag, rotation ---------------------------------------------------------------------

FILE_LEVELS_SQL = f"""SELECT path, file_exists, size,
  CASE WHEN file_exists THEN {page_label_sql('size', zero=False)} ELSE '0 B' END AS size_label,
  size / 2147483648.0::DOUBLE * 100 AS percent_of_limit,
  CASE WHEN NOT file_exists THEN 'info' WHEN size >= {monitor.SIZE_CRITICAL} THEN 'critical' WHEN size >= {monitor.SIZE_WARNING} THEN 'warning' ELSE 'ok' END AS alert_level
FROM files"""
_LAG = "greatest(0, f.size - p.position)"
LAG_LEVELS_SQL = f"""SELECT path, lag_bytes, CASE WHEN known THEN {page_label_sql('lag_bytes', zero=False)} ELSE '0 B' END AS lag_label,
  CASE WHEN NOT known THEN 'info' WHEN lag_bytes >= {monitor.LAG_CRITICAL} THEN 'critical' WHEN lag_bytes >= {monitor.LAG_WARNING} THEN 'warning' ELSE 'ok' END AS alert_level,
  total_lines FROM (SELECT f.path, p.path IS NOT NULL AS known, CASE WHEN p.path IS NULL THEN 0 ELSE {_LAG} END AS lag_bytes,
  coalesce(p.total_lines, 0) AS total_lines FROM files f LEFT JOIN progress p ON f.path = p.path)"""


def _file_levels(spark, sf_dir) -> DataFrame:
    return monitor.file_alerts(fx.tracked_files(spark, sf_dir))


def _lag_levels(spark, sf_dir) -> DataFrame:
    return monitor.ingest_lag(fx.tracked_files(spark, sf_dir), fx.ingest_files(spark, sf_dir))


@query("file_alerts", on_files(FILE_LEVELS_SQL))
def file_alerts(spark, sf_dir):
    return _file_levels(spark, sf_dir)


@query("ingest_lag", on_files(LAG_LEVELS_SQL))
def ingest_lag(spark, sf_dir):
    return _lag_levels(spark, sf_dir)


@query("rotation_stats", on_files(f"""
SELECT total_rotated_files, verified_files, total_rotated_files - verified_files AS pending_verification, total_rotated_size,
  {page_label_sql('total_rotated_size', zero=False)} AS total_rotated_size_label, strftime(last_rotation, '%Y-%m-%d %H:%M:%S') AS last_rotation
FROM (SELECT count(*) AS total_rotated_files, CAST(count_if(safe_to_delete) AS BIGINT) AS verified_files, CAST(sum(rotated_size) AS BIGINT) AS total_rotated_size,
  max(processing_start_time) AS last_rotation FROM records)"""))
def rotation_stats(spark, sf_dir):
    return monitor.rotation_stats(fx.ingest_records(spark, sf_dir))


@query("overall_severity", on_files(f"""
SELECT CASE max(CASE alert_level WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'ok' END AS overall_status
FROM (SELECT alert_level FROM ({FILE_LEVELS_SQL}) UNION ALL SELECT alert_level FROM ({LAG_LEVELS_SQL}))"""))
def overall_severity(spark, sf_dir):
    return monitor.overall_severity(_file_levels(spark, sf_dir), _lag_levels(spark, sf_dir))


ALERT = monitor.ALERT_TEXTS


@query("alert_rows", on_files(f"""
SELECT path, 'size' AS about, alert_level AS type, concat(split_part(path, '/', 4), CASE alert_level WHEN 'critical' THEN '{ALERT['size_critical']}' ELSE '{ALERT['size_warning']}' END, size_label) AS message,
  concat('{ALERT['size_details_before']}', printf('%.1f', percent_of_limit), '{ALERT['size_details_after']}') AS details FROM ({FILE_LEVELS_SQL}) WHERE alert_level IN ('critical', 'warning')
UNION ALL SELECT path, 'lag', alert_level, concat(split_part(path, '/', 4), CASE alert_level WHEN 'critical' THEN '{ALERT['lag_critical']}' ELSE '{ALERT['lag_warning']}' END, lag_label),
  concat('{ALERT['lag_details_before']}', lag_label) FROM ({LAG_LEVELS_SQL}) WHERE alert_level IN ('critical', 'warning')"""))
def alert_rows(spark, sf_dir):
    return monitor.alert_rows(_file_levels(spark, sf_dir), _lag_levels(spark, sf_dir))


@query("load_verify", """
SELECT concat('fw-', CAST(l_orderkey AS VARCHAR)) AS file, count(*) AS parsed_rows, CAST(count_if(l_quantity <> 50) AS BIGINT) AS stored_rows,
  count_if(l_quantity <> 50) = count(*) AS safe_to_delete FROM lineitem GROUP BY l_orderkey""")
def load_verify(spark, sf_dir):
    """One file per order: rows of quantity 50 were parsed, but are missing in the target."""
    parsed = fx.read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("fw-"), F.col("l_orderkey").cast("string")).alias("file"), "l_quantity"
    )
    expected = parsed.groupBy("file").agg(F.count(F.lit(1)).alias("parsed_rows"))
    return monitor.load_verify(expected, parsed.where(F.col("l_quantity") != 50))


@query("cleanup_plan", on_files(f"""
SELECT rotated_file, verified_at, safe_to_delete, CASE WHEN NOT safe_to_delete OR verified_at IS NULL THEN 'keep' WHEN verified_at < {AS_OF} - INTERVAL 30 DAY THEN 'purge'
  WHEN verified_at < {AS_OF} - INTERVAL 7 DAY THEN 'archive' ELSE 'keep' END AS cleanup FROM records"""))
def cleanup_plan(spark, sf_dir):
    records = fx.ingest_records(spark, sf_dir)
    return monitor.cleanup_plan(records, fx.AS_OF).select(
        "rotated_file", "verified_at", "safe_to_delete", "cleanup"
    )


FRESH_SQL = f"""SELECT device_name, max(ts) AS last_seen, CAST(epoch({AS_OF}) - epoch(max(ts)) AS BIGINT) AS age_seconds,
  epoch({AS_OF}) - epoch(max(ts)) < {ACTIVE_SECONDS} AS is_active FROM flows WHERE ts <= {AS_OF} GROUP BY device_name"""


def _freshness(spark, sf_dir) -> DataFrame:
    return monitor.source_freshness(
        fx.flows(spark, sf_dir, until=fx.AS_OF), fx.AS_OF, "ts", active_seconds=ACTIVE_SECONDS
    )


@query("source_freshness", on_flows(FRESH_SQL))
def source_freshness(spark, sf_dir):
    return _freshness(spark, sf_dir)


@query("source_freshness_default", on_flows("""
SELECT device_name, max(ts) AS last_seen, CAST(floor(epoch((SELECT max(ts) FROM flows))) - floor(epoch(max(ts))) AS BIGINT) AS age_seconds,
  floor(epoch((SELECT max(ts) FROM flows))) - floor(epoch(max(ts))) < 300 AS is_active FROM flows GROUP BY device_name"""))
def source_freshness_default(spark, sf_dir):
    """With the default of five minutes, as of the newest row."""
    rows = fx.flows(spark, sf_dir)
    newest = rows.agg(F.max("ts").alias("ts")).first()["ts"]
    return monitor.source_freshness(rows, newest, "ts")


@query("source_status_counts", on_flows(f"""
SELECT count(*) AS total_sources, CAST(count_if(known AND is_active) AS BIGINT) AS active_sources, CAST(count_if(known AND NOT is_active) AS BIGINT) AS inactive_sources,
  CAST(count_if(NOT known) AS BIGINT) AS pending_sources FROM (SELECT *, device_name IN ({', '.join(f"'{d}'" for d in APPROVED)}) AS known FROM ({FRESH_SQL}))"""))
def source_status_counts(spark, sf_dir):
    return monitor.source_status_counts(_freshness(spark, sf_dir), APPROVED)


@query("source_activity", on_flows(f"""
SELECT device_name, CAST(count_if(ts <= {AS_OF} AND ts >= date_trunc('day', {AS_OF})) AS BIGINT) AS logs_today,
  CAST(count_if(ts <= {AS_OF} AND ts >= {AS_OF} - INTERVAL 1 HOUR) AS BIGINT) AS logs_last_hour, count(*) AS total_logs FROM flows GROUP BY device_name"""))
def source_activity(spark, sf_dir):
    return monitor.source_activity(fx.flows(spark, sf_dir), fx.AS_OF, "ts")


@query("status_summary", on_files(f"""
SELECT total_files, present_files, total_size, {page_label_sql('total_size', zero=False)} AS total_size_label, registry_last_updated
FROM (SELECT count(*) AS total_files, CAST(count_if(file_exists) AS BIGINT) AS present_files, CAST(sum(size) AS BIGINT) AS total_size, max(modified) AS registry_last_updated FROM files)"""))
def status_summary(spark, sf_dir):
    return monitor.status_summary(fx.tracked_files(spark, sf_dir))


# --- sources ----------------------------------------------------------------------------------

def _scanned(spark, rows: DataFrame, name: str) -> DataFrame:
    path = f"{scratch_dir(spark, name)}/table"
    rows.write.parquet(path)
    return tables.scan(spark, path, rows.schema)


@query("scan_flows", on_flows("SELECT * FROM flows"))
def scan_flows(spark, sf_dir):
    """The stored table, scanned whole."""
    return _scanned(spark, fx.flows(spark, sf_dir), "scan-flows")


@query("scan_urls", on_urls("SELECT * FROM urls"))
def scan_urls(spark, sf_dir):
    return _scanned(spark, fx.urls(spark, sf_dir), "scan-urls")


# Files that lines land in, so that a stream over them takes several batches.
LANDING_FILES = 8


def land_lines(spark, lines: DataFrame, name: str, files: int | None = LANDING_FILES, **options: str) -> str:
    """Write lines as text files of a landing folder, dealt by a hash of the line; without a number of files, each task
    writes the lines that it has, and none is shuffled."""
    path = f"{scratch_dir(spark, name)}/lines"
    dealt = lines if files is None else lines.repartition(files, F.xxhash64("line"))
    dealt.select(F.col("line").alias("value")).write.options(**options).text(path)
    return path


@query("src_syslog_lines", on_lines("kv_lines", "SELECT line, true AS has_file FROM kv_lines"))
def src_syslog_lines(spark, sf_dir):
    path = land_lines(spark, fx.kv_lines(spark, sf_dir), "syslog")
    lines = syslog.read_syslog(spark, path)
    return lines.select("line", F.col("file").endswith(".txt").alias("has_file"))


@query("src_rotated_archive", on_lines("traffic_lines", "SELECT line, true AS zipped FROM traffic_lines"))
def src_rotated_archive(spark, sf_dir):
    path = land_lines(spark, fx.traffic_lines(spark, sf_dir), "rotated", compression="gzip")
    lines = syslog.read_rotated(spark, path)
    return lines.select("line", F.col("file").endswith(".gz").alias("zipped"))


@query("src_ingest_registry", """
SELECT concat('/var/log/fw-', CAST(o_orderkey AS VARCHAR), '.log') AS path, CAST(floor(o_totalprice * 5000) AS BIGINT) AS size,
  o_orderkey * 10 AS position, 1 AS rotated_files, o_orderstatus = 'F' AS verified, o_orderdate AS modified,
  concat('/var/log/fw-', CAST(o_orderkey AS VARCHAR), '.log.1.gz') AS rotated_file,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS verified_at FROM orders""")
def src_ingest_registry(spark, sf_dir):
    """One registry document per order, written as JSON and read back as its two tables."""
    done = F.col("o_orderstatus") == "F"
    name = F.concat(F.lit("/var/log/fw-"), F.col("o_orderkey").cast("string"), F.lit(".log"))
    when = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double")
    piece = F.concat(name, F.lit(".1.gz"))
    info = F.struct(
        F.floor(F.col("o_totalprice") * 5000).cast("bigint").alias("size"),
        when.alias("last_modified"),
        (F.col("o_orderkey") * 10).alias("last_processed_position"),
        F.array(piece).alias("rotated_files"),
        done.alias("clickhouse_verified"),
    )
    record = F.struct(
        name.alias("original_file"),
        piece.alias("rotated_file"),
        F.when(done, when).otherwise(0.0).alias("clickhouse_verification_time"),
        done.alias("safe_to_delete"),
    )
    documents = fx.read(spark, sf_dir, "orders").select(
        F.create_map(name, info).alias("file_info"),
        F.array(record).alias("processed_records"),
        when.alias("last_updated"),
    )
    path = f"{scratch_dir(spark, 'registry')}/documents"
    documents.write.json(path)
    read = registry.read_registry(spark, path, one_document_per_line=True)
    files = registry.file_progress(read).select(
        "path", "size", "position", "rotated_files", "verified", "modified"
    )
    records = registry.processed_records(read).select(
        F.col("original_file").alias("path"), "rotated_file", "verified_at"
    )
    return files.join(records, "path")


@query("file_inventory", """
SELECT concat('fw-', CAST(l_suppkey % 8 AS VARCHAR), '.log') AS base, true AS file_exists, CAST(3 AS BIGINT) AS rotated_files, true AS has_size
FROM lineitem GROUP BY ALL""")
def file_inventory(spark, sf_dir):
    """Log files of each device with three rotated pieces, listed without reading them."""
    path = f"{scratch_dir(spark, 'inventory')}/files"
    lines = fx.kv_lines(spark, sf_dir)
    land_pieces(lines, path)
    files = registry.list_files(spark, path, glob="part-*")
    named = files.withColumn(
        "name", F.url_decode(F.regexp_extract("path", "name=([^/]+)/", 1))
    )
    one_per_piece = named.groupBy("name").agg(
        F.sum("size").alias("size"), F.max("modified").alias("modified")
    )
    found = registry.file_inventory(one_per_piece)
    return found.select(
        "base", "file_exists", "rotated_files", (F.col("total_size") >= F.col("size")).alias("has_size")
    )


def land_pieces(lines: DataFrame, path: str) -> None:
    """Lines below a folder per device and rotated piece."""
    device = F.lower(F.regexp_extract("line", 'devname="([^"]+)"', 1))
    piece = F.pmod(F.xxhash64("line"), F.lit(4))
    suffix = F.when(piece == 0, "").otherwise(F.concat(F.lit("."), piece.cast("string"), F.lit(".gz")))
    named = lines.select(
        F.col("line").alias("value"), F.concat(device, F.lit(".log"), suffix).alias("name")
    )
    named.write.partitionBy("name").text(path)


# --- sinks and layout -------------------------------------------------------------------------

def _month_sql(where: str = "") -> str:
    return f"""SELECT CAST(strftime(ts, '%Y%m') AS INTEGER) AS ym, count(*) AS events, CAST(sum(bytes_sent) AS BIGINT) AS total_sent,
  min(ts) AS first_ts, max(ts) AS last_ts FROM flows {where} GROUP BY ALL"""


def _by_month(df: DataFrame) -> DataFrame:
    return df.groupBy("ym").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("bytes_sent").alias("total_sent"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


@query("sink_partitioned_append", on_flows(_month_sql()))
def sink_partitioned_append(spark, sf_dir):
    """Two appends to one table by month."""
    path = f"{scratch_dir(spark, 'append')}/flows"
    rows = fx.flows(spark, sf_dir)
    tables.append(rows.where(F.col("action") == "accept"), path, "ts")
    tables.append(rows.where(F.col("action") != "accept"), path, "ts")
    return _by_month(spark.read.parquet(path))


CLUSTER = ["ts", "src_ip", "dst_ip"]


def _clustered(spark, sf_dir, name: str, **options) -> str:
    path = f"{scratch_dir(spark, name)}/flows"
    tables.write_clustered(fx.flows(spark, sf_dir), path, CLUSTER, "ts", **options)
    return path


@query("layout_partitioned", on_flows(_month_sql("WHERE ts >= TIMESTAMP '1999-03-01' AND ts <= TIMESTAMP '1999-08-31 23:59:59'")))
def layout_partitioned(spark, sf_dir):
    """A half year of a table by month: only its months are read."""
    from flowlens.operators.filters import TimeWindow

    path = f"{scratch_dir(spark, 'months')}/flows"
    tables.append(fx.flows(spark, sf_dir), path, "ts")
    window = TimeWindow(datetime(1999, 3, 1), datetime(1999, 8, 31, 23, 59, 59))
    return _by_month(spark.read.parquet(path).where(window.predicate("ts", ym="ym")))


@query("layout_clustered", on_flows(f"SELECT *, CAST(strftime(ts, '%Y%m') AS INTEGER) AS ym FROM flows ORDER BY {FLOW_ORDER_SQL}"))
def layout_clustered(spark, sf_dir):
    return spark.read.parquet(_clustered(spark, sf_dir, "clustered"))


@query("layout_bloom", on_flows("SELECT *, CAST(strftime(ts, '%Y%m') AS INTEGER) AS ym FROM flows WHERE src_user = 'user7' OR hostname = 'h7.example.com'"))
def layout_bloom(spark, sf_dir):
    """Point look-ups on columns with Bloom filters."""
    path = _clustered(spark, sf_dir, "bloom", bloom=["src_user", "hostname"])
    return spark.read.parquet(path).where("src_user = 'user7' OR hostname = 'h7.example.com'")


_RETAIN = f"WHERE ts >= {AS_OF} - INTERVAL {tables.RETENTION_DAYS} DAY"


_EDGE = fx.AS_OF - timedelta(days=tables.RETENTION_DAYS)
_EDGE_YM = _EDGE.year * 100 + _EDGE.month


@query("retention_90d", on_flows(_month_sql(_RETAIN)))
def retention_90d(spark, sf_dir):
    """The table after the old rows are gone; whole old months are never read."""
    root = scratch_dir(spark, "retention")
    tables.append(fx.flows(spark, sf_dir), f"{root}/all", "ts")
    tables.apply_retention(spark, f"{root}/all", f"{root}/kept", fx.AS_OF, "ts")
    return _by_month(spark.read.parquet(f"{root}/kept"))


@query("retention_in_place", on_flows(f"""
SELECT ym, count(*) AS events, CAST(sum(bytes_sent) AS BIGINT) AS total_sent, min(ts) AS first_ts, max(ts) AS last_ts,
  ym <> {_EDGE_YM} AS files_untouched, true AS nothing_left_to_do
FROM (SELECT *, CAST(strftime(ts, '%Y%m') AS INTEGER) AS ym FROM flows {_RETAIN}) GROUP BY ym"""))
def retention_in_place(spark, sf_dir):
    """Old rows go where they lie: later months keep their files, only the month of the limit has new ones. A second run
    finds nothing to do."""
    name = tables.scratch_table(spark, "flows")
    tables.create_table(fx.flows(spark, sf_dir), name, "ts")

    def files() -> DataFrame:
        return spark.table(name).select("ym", F.col("_metadata.file_path").alias("file")).distinct()

    before = spark.createDataFrame([tuple(row) for row in files().collect()], "ym int, file string")
    tables.expire(spark, name, fx.AS_OF, "ts")
    again = tables.expire(spark, name, fx.AS_OF, "ts")
    kept = files().join(before.withColumn("old", F.lit(True)), ["ym", "file"], "left")
    untouched = kept.groupBy("ym").agg(F.coalesce(F.every("old"), F.lit(False)).alias("files_untouched"))
    rows = _by_month(spark.table(name)).join(untouched, "ym")
    return rows.withColumn("nothing_left_to_do", F.lit(again == {}))


@query("retention_plan", on_flows(f"""
SELECT DISTINCT ym, CASE WHEN ym < {_EDGE_YM} THEN 'drop' WHEN ym = {_EDGE_YM} THEN 'rewrite' ELSE 'keep' END AS step
FROM (SELECT CAST(strftime(ts, '%Y%m') AS INTEGER) AS ym FROM flows)"""))
def retention_plan(spark, sf_dir):
    path = f"{scratch_dir(spark, 'plan')}/flows"
    tables.append(fx.flows(spark, sf_dir), path, "ts")
    return tables.retention_plan(spark.read.parquet(path), fx.AS_OF)


@query("evolve_schema", on_flows("""
SELECT ts, src_ip, dst_ip, bytes_sent, CASE WHEN log_source = 'flows_kv' THEN src_user ELSE '' END AS src_user FROM flows"""))
def evolve_schema(spark, sf_dir):
    """Files from before a column was added, and files with it, read as one table."""
    root = scratch_dir(spark, "evolve")
    rows = fx.flows(spark, sf_dir).select("ts", "src_ip", "dst_ip", "bytes_sent", "src_user", "log_source")
    new = rows.where(F.col("log_source") == "flows_kv").drop("log_source")
    old = rows.where(F.col("log_source") != "flows_kv").drop("src_user", "log_source")
    old.write.parquet(f"{root}/old")
    new.write.parquet(f"{root}/new")
    return tables.scan_evolved(
        spark, [f"{root}/old", f"{root}/new"], new.schema, defaults={"src_user": ""}
    )


_EXPORT = ["ts", "src_ip", "dst_port", "rule_name", "src_user", "bytes_sent"]


@query("sink_csv", on_flows("""
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, src_ip, CAST(dst_port AS VARCHAR) AS dst_port, concat('"', rule_name, '", or so') AS rule_name,
  src_user, CAST(bytes_sent AS VARCHAR) AS bytes_sent FROM flows"""))
def sink_csv(spark, sf_dir):
    """Export with quotes and commas in a field, read back as text."""
    path = f"{scratch_dir(spark, 'csv')}/export"
    rows = fx.flows(spark, sf_dir).select(*_EXPORT)
    tables.export_csv(
        rows.withColumn("rule_name", F.concat(F.lit('"'), "rule_name", F.lit('", or so'))), path
    )
    schema = T.StructType([T.StructField(c, T.StringType()) for c in _EXPORT])
    return spark.read.schema(schema).options(header="true", escape='"', nullValue="NULL").csv(path)


@query("sink_json", on_flows("""
SELECT src_ip, CAST(dst_port AS VARCHAR) AS dst_port, CASE WHEN src_user = '' THEN 'unknown' ELSE src_user END AS src_user, rule_name AS policy FROM flows"""))
def sink_json(spark, sf_dir):
    """Export with detail fields that only fill what the row lacks, read back."""
    path = f"{scratch_dir(spark, 'json')}/export"
    details = F.create_map(
        F.lit("Policy:"), F.col("rule_name"), F.lit("SRC_USER"), F.lit("unknown"),
        F.lit("Src_IP"), F.lit("other"),
    )
    rows = fx.flows(spark, sf_dir).select(
        F.col("src_ip").alias("SRC_IP"), F.col("dst_port").alias("Dst_Port"),
        F.col("src_user").alias("Src_User"), details.alias("details"),
    )
    tables.export_json(rows, path, details="details")
    return spark.read.schema("src_ip STRING, dst_port STRING, src_user STRING, policy STRING").json(path)
