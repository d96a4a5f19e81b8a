"""Log tables and log lines derived from the given tables.

The SQL text runs unchanged in Spark and in DuckDB, so that both sides of a check start from the
same rows: braces name the input tables, which Spark fills with DataFrames.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import session

AS_OF = datetime(2001, 8, 1, 12, 0, 0)
URL_AS_OF = datetime(2024, 1, 31, 0, 0, 0)

FLOWS = """
SELECT l_shipdate + (l_orderkey * 7919 + l_linenumber * 131) % 86400 * INTERVAL '1' SECOND AS ts,
  concat('FW-', CAST(l_suppkey % 8 AS VARCHAR(20))) AS device_name,
  CASE WHEN l_suppkey % 10 < 8 THEN concat('10.', CAST(o_custkey % 4 AS VARCHAR(20)), '.', CAST(o_custkey % 16 AS VARCHAR(20)), '.', CAST(o_custkey % 250 AS VARCHAR(20)))
       WHEN l_suppkey % 10 = 8 THEN concat('172.', CAST(o_custkey % 40 AS VARCHAR(20)), '.7.', CAST(o_custkey % 250 AS VARCHAR(20)))
       ELSE concat('203.0.113.', CAST(o_custkey % 250 AS VARCHAR(20))) END AS src_ip,
  CAST(1024 + l_orderkey % 60000 AS INT) AS src_port,
  concat('198.51.100.', CAST(l_partkey % 200 AS VARCHAR(20))) AS dst_ip,
  CASE l_partkey % 6 WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 53 WHEN 3 THEN 22 WHEN 4 THEN 3389 ELSE 8080 END AS dst_port,
  CASE l_returnflag WHEN 'A' THEN 'accept' WHEN 'R' THEN 'deny' ELSE 'close' END AS action,
  CASE l_partkey % 5 WHEN 0 THEN 6 WHEN 1 THEN 17 WHEN 2 THEN 1 WHEN 3 THEN 47 ELSE 99 END AS protocol,
  CAST(floor(l_quantity * 1000) AS BIGINT) AS bytes_received, CAST(floor(l_extendedprice * 100) AS BIGINT) AS bytes_sent,
  CAST(l_quantity AS INT) AS packets_sent, CAST(l_linenumber AS INT) AS packets_received,
  CAST(l_suppkey % 300 AS INT) AS elapsed_time, o_orderpriority AS rule_name,
  CASE WHEN o_custkey % 5 = 0 THEN '' ELSE concat('user', CAST(o_custkey AS VARCHAR(20))) END AS src_user,
  p_type AS app_category, p_brand AS application, concat('h', CAST(l_partkey % 50 AS VARCHAR(20)), '.example.com') AS hostname,
  sn.n_name AS dst_country, cn.n_name AS src_country,
  CASE l_linenumber % 3 WHEN 0 THEN 'flows_kv' WHEN 1 THEN 'flows_pan' ELSE 'threats' END AS log_source
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey
 JOIN {part} ON l_partkey = p_partkey JOIN {nation} sn ON s_nationkey = sn.n_nationkey JOIN {nation} cn ON c_nationkey = cn.n_nationkey
"""

URLS = """
SELECT e.ts AS ts,
  concat('FW-', CAST(e.user_id % 4 AS VARCHAR(20))) AS device_name, p.url AS url,
  lower(regexp_extract(p.url, '^[a-z]+://([^/?#]+)', 1)) AS url_domain,
  CASE e.event_type WHEN 'click' THEN 'news' WHEN 'view' THEN 'search-engines' WHEN 'purchase' THEN 'business-and-economy' WHEN 'signup' THEN 'social-networking' ELSE '' END AS url_category,
  CASE WHEN e.event_type = 'error' THEN 'block' WHEN e.user_id % 11 = 0 THEN 'deny' ELSE 'allow' END AS action,
  concat('10.9.', CAST(e.user_id % 8 AS VARCHAR(20)), '.', CAST(e.user_id % 250 AS VARCHAR(20))) AS source_address,
  concat('198.51.100.', CAST(p.page_id % 200 AS VARCHAR(20))) AS destination_address,
  CASE WHEN e.user_id % 7 = 0 THEN '' ELSE concat('CORP#u', CAST(e.user_id AS VARCHAR(20))) END AS source_user_raw,
  CASE e.event_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE '' END AS http_method,
  CASE WHEN e.event_type = 'error' THEN 403 ELSE 200 END AS response_code,
  CAST(floor(e.value * 100) AS BIGINT) AS bytes_sent, CAST(e.event_id % 5000 AS BIGINT) AS bytes_received, CAST(e.event_id % 900 AS INT) AS response_time_ms,
  CASE WHEN e.user_id % 7 = 0 THEN '' ELSE concat('u', CAST(e.user_id AS VARCHAR(20))) END AS source_user,
  concat('Agent/', CAST(e.user_id % 5 AS VARCHAR(20)), '.0') AS user_agent,
  concat('rule-', CAST(e.user_id % 6 AS VARCHAR(20))) AS rule_name,
  CASE e.event_type WHEN 'view' THEN 'web-browsing' WHEN 'error' THEN '' ELSE 'ssl' END AS application,
  e.event_id AS session_id, concat('raw ', CAST(e.event_id AS VARCHAR(20))) AS raw_message
FROM (SELECT *, event_id % (SELECT count(*) FROM {pages}) AS page_ref FROM {events}) e JOIN {pages} p ON p.page_id = e.page_ref
"""

# Source port, addresses, counters and dates go wrong in some of these lines.
KV_LINES = """
SELECT concat(CASE WHEN packets_received = 6 THEN 'x=1 action=first ' ELSE '' END,
  CASE WHEN packets_sent = 7 THEN '' ELSE concat('date=', substr(CAST(ts AS VARCHAR(30)),1,10), ' ') END,
  'time=', substr(CAST(ts AS VARCHAR(30)),12,8), ' devname="', device_name, '" note="" msg="from ', src_country, '"',
  ' eventtime=', CASE WHEN packets_sent = 8 THEN 'soon' WHEN packets_sent = 9 THEN '99999999999999999999' ELSE CAST(1000000000000000 + bytes_sent * 1000003 AS VARCHAR(20)) END,
  ' srcip=', CASE WHEN dst_port = 22 AND packets_sent % 10 = 0 THEN '10.11.40.' WHEN dst_port = 22 AND packets_sent % 10 = 1 THEN '2001:db8::1' ELSE src_ip END,
  ' srcport=', CASE packets_sent WHEN 3 THEN '-4' WHEN 4 THEN 'abc' WHEN 5 THEN '70000' ELSE CAST(src_port AS VARCHAR(10)) END,
  ' dstip=', dst_ip, ' dstport=', CAST(dst_port AS VARCHAR(10)), ' proto=', CAST(protocol AS VARCHAR(10)),
  ' action="', action, '" policyname="', rule_name, '" appcat="', app_category, '" user="', src_user, '" hostname=', hostname,
  ' srccountry="', src_country, '" dstcountry="', dst_country, '" duration=', CAST(elapsed_time AS VARCHAR(10)),
  ' sentbyte=', CASE WHEN packets_sent = 10 THEN '99999999999999999999' WHEN packets_sent = 11 THEN '1.5' ELSE CAST(bytes_sent AS VARCHAR(20)) END,
  ' rcvdbyte=', CAST(bytes_received AS VARCHAR(20)), ' sentpkt=', CAST(packets_sent AS VARCHAR(10)),
  ' rcvdpkt=', CAST(packets_received AS VARCHAR(10)), ' tail=9') AS line
FROM {flows} WHERE log_source = 'flows_kv'
"""

_HEADER = """concat(substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(extract(month FROM ts) AS INT) * 3 - 2, 3), ' ',
  lpad(CAST(extract(day FROM ts) AS VARCHAR(10)), 2, ' '), ' ', substr(CAST(ts AS VARCHAR(30)),12,8), ' ', {host}, ' 1')"""
_SLASH_TIME = "replace(substr(CAST(ts AS VARCHAR(30)),1,19),'-','/')"


def _csv_line(fields: dict[int, str], last: int) -> str:
    """SQL for fields 1..last, each after a comma; those not given are blank."""
    given = [f"',', {fields[i]}" if i in fields else "','" for i in range(1, last + 1)]
    return ", ".join(given)


def _text(column: str) -> str:
    return f"CAST({column} AS VARCHAR(20))"


# One line in eleven is of another type, one in thirteen is cut off.
TRAFFIC_LINES = f"""
SELECT CASE WHEN elapsed_time % 13 = 12 THEN concat('Jan 1 00:00:00 ', device_name)
  ELSE concat({_HEADER.format(host="device_name")}, {_csv_line({
    1: _SLASH_TIME,
    2: "'0001'",
    3: "CASE WHEN elapsed_time % 11 = 10 THEN 'SYSTEM' ELSE 'TRAFFIC' END",
    4: "'end'",
    6: _SLASH_TIME,
    7: "CASE WHEN dst_port = 22 AND packets_sent % 10 = 0 THEN '10.11.40.' ELSE src_ip END",
    8: "dst_ip",
    9: "'0.0.0.0'",
    10: "'bad'",
    11: "rule_name",
    12: "src_user",
    14: "application",
    18: "concat('eth', CAST(src_port % 4 AS VARCHAR(10)))",
    19: "concat('eth', CAST(dst_port % 4 AS VARCHAR(10)))",
    22: _text("bytes_received"),
    24: _text("src_port"),
    25: _text("dst_port"),
    29: "CASE protocol WHEN 6 THEN 'tcp' WHEN 17 THEN 'UDP' WHEN 1 THEN 'icmp' WHEN 47 THEN 'gre' ELSE '99' END",
    30: "concat(upper(substr(action,1,1)), substr(action,2,20))",
    31: _text("bytes_sent"),
    32: _text("bytes_received"),
    33: _text("packets_sent"),
    34: "'5'",
    35: "CASE WHEN packets_sent = 7 THEN 'soon' WHEN packets_sent = 8 THEN '' ELSE " + _SLASH_TIME + " END",
    36: _text("elapsed_time"),
    37: "app_category",
    42: "src_country",
    43: "dst_country",
    44: "CASE WHEN packets_sent % 2 = 0 THEN CAST(packets_sent + 100 AS VARCHAR(10)) ELSE '' END",
    45: "CASE WHEN packets_sent % 3 = 0 THEN 'x' ELSE '' END",
    52: "CASE WHEN packets_sent % 2 = 0 THEN concat('DEV-', device_name) ELSE '' END",
    58: "'N/A'",
    63: "CASE WHEN packets_sent % 4 = 0 THEN 'IPSec' ELSE '' END",
    70: _text("bytes_sent"),
    80: "'uuid-1'",
}, 80)}) END AS line
FROM {{flows}} WHERE log_source = 'flows_pan'
"""

URL_FIELDS = {
    1: _SLASH_TIME,
    2: "'S01'",
    3: "CASE WHEN session_id % 13 = 12 THEN 'TRAFFIC' ELSE 'THREAT' END",
    4: "'url'",
    6: "CASE WHEN session_id % 19 = 18 THEN '' ELSE " + _SLASH_TIME + " END",
    7: "source_address",
    8: "destination_address",
    11: "rule_name",
    12: "CASE WHEN session_id % 2 = 0 THEN replace(source_user_raw, '#', chr(92)) WHEN source_user = '' THEN '' ELSE concat(source_user, '@corp') END",
    14: "application",
    15: "'vsys1'",
    22: _text("session_id"),
    24: "'40000'",
    25: "CASE WHEN session_id % 5 = 0 THEN 'none' ELSE '443' END",
    29: "'TCP'",
    30: "action",
    31: """concat('"', url, CASE WHEN session_id % 4 = 0 THEN ',a&b=1' ELSE '' END, '"')""",
    33: "url_category",
    34: "'informational'",
    35: "'client-to-server'",
    36: _text("session_id + 7"),
    38: "'Here'",
    40: "CASE WHEN session_id % 3 = 0 THEN 'text/html' ELSE 'a\"b' END",
    45: """concat('"', user_agent, ' (X11, Linux)"')""",
    48: """'""'""",
    58: "CASE WHEN session_id % 2 = 0 THEN concat('DEV-', device_name) ELSE '' END",
    62: "lower(http_method)",
    74: """'"a,b"'""",
    75: "'uuid-2'",
    105: "concat(replace(substr(CAST(ts AS VARCHAR(30)),1,19),' ','T'), '.250', CASE session_id % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+03:00' ELSE '' END)",
}
URL_LAST_FIELD = 107
URL_LINES = f"""
SELECT CASE WHEN session_id % 17 = 16 THEN 'Jan 1 00:00:00 cut'
  ELSE concat({_HEADER.format(host="device_name")}, {_csv_line(URL_FIELDS, URL_LAST_FIELD)}) END AS line
FROM {{urls}}
"""

# URLs with the forms that decomposing has to tell apart.
URL_FORMS = """
SELECT ts, session_id, url AS plain_url, url_domain AS plain_domain,
  CASE session_id % 8 WHEN 1 THEN regexp_replace(url, '^[a-z]+://', '') WHEN 2 THEN regexp_replace(url, '^([a-z]+://[^/?#]+)', concat('https://', url_domain, ':8080'))
    WHEN 3 THEN replace(url, '://', '://me@') WHEN 4 THEN concat(url, '&b=&c=1&c=2') WHEN 5 THEN concat(url, repeat('x', 2100))
    WHEN 6 THEN concat('ftp://10.1.', CAST(session_id % 250 AS VARCHAR(20)), '.7:2121/a//b;v=1?q=%20a&q=2') WHEN 7 THEN 'http://a1b2c3d4e5.tk:bad/' ELSE url END AS url
FROM {urls}
"""

# Every order stands for a tracked log file, every line item for a rotated piece of one.
INGEST_FILES = """
SELECT concat('/var/log/fw-', CAST(o_orderkey AS VARCHAR(20)), '.log') AS path,
  o_orderstatus <> 'P' AS file_exists,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice * 5000) AS BIGINT) ELSE 0 END AS size,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice * 5000) AS BIGINT) ELSE 0 END - (o_orderkey * 7919 % 900 - 200) * 1000000 AS position,
  o_orderkey % 1000 AS total_lines,
  o_orderdate AS modified
FROM {orders} WHERE o_custkey % 10 <> 9
"""
TRACKED_FILES = """
SELECT concat('/var/log/fw-', CAST(o_orderkey AS VARCHAR(20)), '.log') AS path,
  o_orderstatus <> 'P' AS file_exists,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice * 5000) AS BIGINT) ELSE 0 END AS size,
  o_orderdate AS modified
FROM {orders}
"""
INGEST_RECORDS = """
SELECT concat('/var/log/fw-', CAST(l_orderkey AS VARCHAR(20)), '.log') AS original_file,
  concat('/var/log/fw-', CAST(l_orderkey AS VARCHAR(20)), '.log.', CAST(l_linenumber AS VARCHAR(10)), '.gz') AS rotated_file,
  CAST(floor(l_quantity * 1000) AS BIGINT) AS rotated_size,
  CAST(l_quantity AS BIGINT) AS lines_processed,
  l_shipdate AS processing_start_time,
  CASE WHEN l_linestatus = 'F' THEN l_shipdate + INTERVAL '1' DAY END AS verified_at,
  l_linestatus = 'F' AS safe_to_delete
FROM {lineitem}
"""

TABLES = "region nation customer supplier part orders lineitem events pages".split()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over as many tasks as the session's `flowlens.fixture.tasks` says, if it is set.

    A Parquet file of one row group is one task, however many cores wait; the benchmark sets this.
    """
    tasks = df.sparkSession.conf.get("flowlens.fixture.tasks", None)
    return df.repartition(int(tasks), *keys) if tasks else df


def _run(spark: SparkSession, sf_dir: str, sql: str, **given: DataFrame) -> DataFrame:
    names = set(re.findall(r"\{(\w+)\}", sql))
    inputs = {n: given[n] if n in given else read(spark, sf_dir, n) for n in names}
    return spark.sql(sql, **inputs)


def flows(
    spark: SparkSession, sf_dir: str, since: datetime | None = None, until: datetime | None = None
) -> DataFrame:
    """One row per line item.

    Bounds on the event time become bounds on the stored ship date, from which it is made, so that
    the Parquet reader can skip row groups; the caller still filters on `ts` itself.
    """
    lineitem = read(spark, sf_dir, "lineitem")
    if since is not None:
        lineitem = lineitem.where(
            F.col("l_shipdate") > F.lit(str(since - timedelta(days=1))).cast("timestamp_ntz")
        )
    if until is not None:
        lineitem = lineitem.where(F.col("l_shipdate") <= F.lit(str(until)).cast("timestamp_ntz"))
    return _run(spark, sf_dir, FLOWS, lineitem=spread(lineitem, "l_orderkey", "l_linenumber"))


# The same rows with customers joined to orders first, so that one shuffle of the line items is saved.
_BY_ORDER = FLOWS.replace(
    "{orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey",
    "(SELECT * FROM {orders} JOIN {customer} ON o_custkey = c_custkey) ON l_orderkey = o_orderkey",
)


def flow_rounds(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The flows in frames of about ROUND_ROWS line items by a hash of their order, to be written one after the other: the shuffles
    of the joins, which are several times as large as what is stored, then need not lie on disk for all rows at once."""
    rounds = -(-read(spark, sf_dir, "lineitem").count() // session.ROUND_ROWS)
    if rounds < 2:
        return [flows(spark, sf_dir)]

    def of(table: str, key: str, number: int) -> DataFrame:
        return read(spark, sf_dir, table).where(F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(rounds)) == number)

    return [
        _run(spark, sf_dir, _BY_ORDER, lineitem=spread(of("lineitem", "l_orderkey", i), "l_orderkey", "l_linenumber"),
             orders=of("orders", "o_orderkey", i))
        for i in range(rounds)
    ]


def urls(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """One row per event; dealt over a number of tasks if one is given."""
    events = read(spark, sf_dir, "events")
    events = spread(events, "event_id") if tasks is None else events.repartition(tasks, "event_id")
    pages = spread(read(spark, sf_dir, "pages").select("page_id", "url"), "page_id")
    return _run(spark, sf_dir, URLS, events=events, pages=pages)


def kv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, KV_LINES, flows=flows(spark, sf_dir))


def traffic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, TRAFFIC_LINES, flows=flows(spark, sf_dir))


def url_lines(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    return _run(spark, sf_dir, URL_LINES, urls=urls(spark, sf_dir, tasks))


def url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, URL_FORMS, urls=urls(spark, sf_dir))


def ingest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, INGEST_FILES)


def tracked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, TRACKED_FILES)


def ingest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, INGEST_RECORDS)


def source_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The three traffic tables in their own column names, as the parsers would store them."""
    rows = flows(spark, sf_dir)

    def shaped(source: str, names: dict[str, str]) -> DataFrame:
        mine = rows.where(F.col("log_source") == source)
        extra = {
            "raw_message": F.concat_ws(" ", "device_name", "src_ip", "dst_ip"),
            "type": F.concat(F.lit("T"), F.col("packets_received").cast("string")),
            "in_if": F.concat(F.lit("in"), (F.col("src_port") % 4).cast("string")),
            "out_if": F.concat(F.lit("out"), (F.col("dst_port") % 4).cast("string")),
        }
        return mine.withColumns(extra).select(*[F.col(c).alias(n) for n, c in names.items()])

    pan = {
        "timestamp": "ts", "raw_message": "raw_message", "src_ip": "src_ip", "src_port": "src_port",
        "dst_ip": "dst_ip", "dst_port": "dst_port", "action": "action", "protocol": "protocol",
        "bytes_received": "bytes_received", "bytes_sent": "bytes_sent",
        "packets_sent": "packets_sent", "packets_received": "packets_received",
        "elapsed_time": "elapsed_time", "src_interface": "in_if", "dst_interface": "out_if",
        "rule_name": "rule_name", "src_user": "src_user", "src_country": "src_country",
        "dst_country": "dst_country", "device_name": "device_name", "application": "application",
        "app_category": "app_category",
    }
    kv = {
        "timestamp": "ts", "raw_message": "raw_message", "srcip": "src_ip", "srcport": "src_port",
        "dstip": "dst_ip", "dstport": "dst_port", "action": "action", "proto": "protocol",
        "rcvdbyte": "bytes_received", "sentbyte": "bytes_sent", "sentpkt": "packets_sent",
        "rcvdpkt": "packets_received", "duration": "elapsed_time", "srcintf": "in_if",
        "dstintf": "out_if", "policyname": "rule_name", "username": "src_user",
        "srccountry": "src_country", "dstcountry": "dst_country", "devname": "device_name",
        "appcat": "app_category", "hostname": "hostname",
    }
    threats = {
        "timestamp": "ts", "raw_message": "raw_message", "source_address": "src_ip",
        "source_port": "src_port", "destination_address": "dst_ip", "destination_port": "dst_port",
        "action": "action", "protocol": "protocol", "bytes_received": "bytes_received",
        "bytes_sent": "bytes_sent", "packets_sent": "packets_sent",
        "packets_received": "packets_received", "elapsed_time": "elapsed_time",
        "inbound_interface": "in_if", "outbound_interface": "out_if", "rule_name": "rule_name",
        "source_user": "src_user", "source_country": "src_country",
        "destination_country": "dst_country", "device_name": "device_name",
        "application": "application", "application_category": "app_category", "type": "type",
        "log_action": "rule_name",
    }
    shapes = {"flows_kv": kv, "flows_pan": pan, "threats": threats}
    return {source: shaped(source, names) for source, names in shapes.items()}
