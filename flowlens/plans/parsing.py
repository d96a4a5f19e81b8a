"""Queries behind the parsers. Their SQL never parses: it states what the rendered row held."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions import net, numbers, text, times, url
from flowlens.operators import parse_kv as kv_parser
from flowlens.operators import parse_positional as positional
from flowlens.operators import validate
from flowlens.plans import fixtures as fx
from flowlens.plans.monitoring import land_lines
from flowlens.plans.registry import _plain, on_flows, on_lines, on_urls, query
from flowlens.schemas import KV_COLUMNS, TRAFFIC_COLUMNS, URL_COLUMNS, URL_POSITIONS
from flowlens.sources import syslog

_LANDED: dict[tuple[str, str, str], str] = {}


def landed(spark, sf_dir: str, kind: str) -> DataFrame:
    """Rendered lines as text files, written once for each session: parsers read files, and code is
    generated for the parser without what renders its lines. Tasks write what they render, packed; so the files grow in
    number with the input, and text is neither shuffled nor stored at full length. Events are dealt before they are
    rendered: their table is small for the lines it makes."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _LANDED:
        if kind == "url":
            lines = fx.url_lines(spark, sf_dir, 4 * spark.sparkContext.defaultParallelism)
        else:
            lines = {"kv": fx.kv_lines, "traffic": fx.traffic_lines}[kind](spark, sf_dir)
        _LANDED[key] = land_lines(spark, lines, f"{kind}-lines", files=None, compression="gzip")
    return syslog.read_syslog(spark, _LANDED[key]).select("line")


AS_OF, URL_AS_OF = f"TIMESTAMP '{fx.AS_OF}'", f"TIMESTAMP '{fx.URL_AS_OF}'"
U64, I64 = 2**64 - 1, 2**63 - 1

# --- key-value lines --------------------------------------------------------------------------

_DATE = "CASE WHEN packets_sent = 7 THEN NULL ELSE substr(CAST(ts AS VARCHAR), 1, 10) END"


@query("parse_kv", on_lines("kv_lines", f"""
SELECT line, {_DATE} AS date, action, concat('from ', src_country) AS msg, '' AS note, device_name AS devname,
  CASE WHEN packets_received = 6 THEN '1' END AS x, '9' AS tail,
  CAST(23 + CASE WHEN packets_sent = 7 THEN 0 ELSE 1 END + CASE WHEN packets_received = 6 THEN 1 ELSE 0 END AS INTEGER) AS pairs
FROM kv_lines"""))
def parse_kv(spark, sf_dir):
    parsed = kv_parser.parse_kv(landed(spark, sf_dir, "kv"))
    names = ["date", "action", "msg", "note", "devname", "x", "tail"]
    return parsed.select(
        "line", *[F.col("kv")[n].alias(n) for n in names], F.size("kv").alias("pairs")
    )


@query("parse_kv_window", on_lines("kv_lines", f"""
SELECT line, {_DATE} AS date, action, CAST(packets_received AS VARCHAR) AS rcvdpkt,
  CASE WHEN packets_sent = 7 AND packets_received = 6 THEN '1' END AS x, CASE WHEN packets_sent = 7 THEN '9' END AS tail,
  CAST(23 + CASE WHEN packets_sent = 7 AND packets_received = 6 THEN 1 ELSE 0 END AS INTEGER) AS pairs FROM kv_lines"""))
def parse_kv_window(spark, sf_dir):
    parsed = kv_parser.parse_kv_window(landed(spark, sf_dir, "kv"))
    names = ["date", "action", "rcvdpkt", "x", "tail"]
    return parsed.select(
        "line", *[F.col("kv")[n].alias(n) for n in names], F.size("kv").alias("pairs")
    )


@query("epoch_micros_ts", on_lines("kv_lines", """
SELECT line, CASE WHEN packets_sent IN (8, 9) THEN NULL ELSE make_timestamp(1000000000000000 + bytes_sent * 1000003) END AS event_timestamp
FROM kv_lines"""))
def epoch_micros_ts(spark, sf_dir):
    return kv_parser.parse_kv_window(landed(spark, sf_dir, "kv")).select("line", "event_timestamp")


_KV_SRC_PORT = "CASE WHEN packets_sent IN (3, 4) THEN 0 WHEN packets_sent = 5 THEN 65535 ELSE src_port END"
_KV_SENT = f"CASE WHEN packets_sent = 10 THEN {I64} WHEN packets_sent = 11 THEN 0 ELSE bytes_sent END"
_KV_EVENT = f"CASE WHEN packets_sent = 8 THEN 0 WHEN packets_sent = 9 THEN {U64} ELSE 1000000000000000 + bytes_sent * 1000003 END"
_BAD_SRC = "dst_port = 22 AND packets_sent % 10 IN (0, 1)"
_KV_RAW = "CASE WHEN dst_port = 22 AND packets_sent % 10 = 0 THEN '10.11.40.' WHEN dst_port = 22 AND packets_sent % 10 = 1 THEN '2001:db8::1' ELSE src_ip END"
_KV_KNOWN = {
    "timestamp": f"CASE WHEN packets_sent = 7 THEN {AS_OF} ELSE ts END",
    "raw_message": "line",
    "devname": "device_name",
    "eventtime": _KV_EVENT,
    "srcip": f"CASE WHEN {_BAD_SRC} THEN '0.0.0.0' ELSE src_ip END",
    "srcport": _KV_SRC_PORT,
    "dstip": "dst_ip",
    "dstport": "dst_port",
    "srccountry": "src_country",
    "dstcountry": "dst_country",
    "proto": "protocol",
    "action": "action",
    "policyname": "rule_name",
    "appcat": "app_category",
    "duration": "elapsed_time",
    "sentbyte": _KV_SENT,
    "rcvdbyte": "bytes_received",
    "sentpkt": "packets_sent",
    "rcvdpkt": "packets_received",
}
_SQL_TYPES = {
    "ts": "TIMESTAMP", "str": "VARCHAR", "ip": "VARCHAR", "u8": "SMALLINT", "u16": "INTEGER",
    "u32": "BIGINT", "u64": "BIGINT", "u64w": "DECIMAL(20,0)",
}


def _expected(columns: dict[str, str], known: dict[str, str]) -> str:
    """SELECT list with the blank value of each column that the lines do not fill."""
    parts = []
    for name, kind in columns.items():
        blank = "'0.0.0.0'" if kind == "ip" else "''" if kind == "str" else "0"
        parts.append(f"CAST({known.get(name, blank)} AS {_SQL_TYPES[kind]}) AS {name}")
    return ", ".join(parts)


KV_TYPED_SQL = (
    f"SELECT {_expected(KV_COLUMNS, _KV_KNOWN)}, src_user AS username, hostname, "
    f"{_KV_RAW} AS srcip_raw, dst_ip AS dstip_raw FROM kv_lines"
)


@query("parse_kv_typed", on_lines("kv_lines", KV_TYPED_SQL))
def parse_kv_typed(spark, sf_dir):
    return kv_parser.parse_kv_typed(landed(spark, sf_dir, "kv"), fx.AS_OF)


@query("clean_numeric", on_lines("kv_lines", f"""
SELECT line, CAST({_KV_SRC_PORT} AS BIGINT) AS port, CAST({_KV_SENT} AS BIGINT) AS sent, CAST({_KV_EVENT} AS DECIMAL(20,0)) AS event
FROM kv_lines"""))
def clean_numeric(spark, sf_dir):
    kv = F.col("kv")
    return kv_parser.parse_kv(landed(spark, sf_dir, "kv")).select(
        "line",
        numbers.clean_uint(kv["srcport"], 65535).alias("port"),
        numbers.clean_uint(kv["sentbyte"]).alias("sent"),
        numbers.clean_uint(kv["eventtime"], U64).alias("event"),
    )


@query("clean_ipv4", on_lines("kv_lines", f"""
SELECT line, {_KV_RAW} AS raw, CASE WHEN {_BAD_SRC} THEN '0.0.0.0' ELSE src_ip END AS cleaned FROM kv_lines"""))
def clean_ipv4(spark, sf_dir):
    raw = F.col("kv")["srcip"]
    return kv_parser.parse_kv(landed(spark, sf_dir, "kv")).select(
        "line", raw.alias("raw"), net.clean_ipv4(raw).alias("cleaned")
    )


@query("split_valid_invalid", on_lines("kv_lines", f"""
SELECT line AS raw_message, {_KV_RAW} AS srcip_raw, NOT ({_BAD_SRC}) AS accepted FROM kv_lines"""))
def split_valid_invalid(spark, sf_dir):
    typed = kv_parser.parse_kv_typed(landed(spark, sf_dir, "kv"), fx.AS_OF)
    return validate.with_accepted(typed).select("raw_message", "srcip_raw", "accepted")


@query("fill_defaults", on_flows(f"""
SELECT coalesce(CASE WHEN packets_sent > 5 THEN ts END, {AS_OF}) AS ts, coalesce(nullif(src_user, 'user7'), '') AS src_user,
  coalesce(nullif(dst_port, 22), 0) AS dst_port, coalesce(nullif(bytes_received, 1000), 0) AS bytes_received FROM flows"""))
def fill_defaults(spark, sf_dir):
    """Columns with gaps made from the flows."""
    gaps = fx.flows(spark, sf_dir).select(
        F.when(F.col("packets_sent") > 5, F.col("ts")).alias("ts"),
        F.nullif(F.col("src_user"), F.lit("user7")).alias("src_user"),
        F.nullif(F.col("dst_port"), F.lit(22)).alias("dst_port"),
        F.nullif(F.col("bytes_received"), F.lit(1000)).alias("bytes_received"),
    )
    return validate.fill_defaults(gaps, fx.AS_OF)


# --- positional traffic lines -----------------------------------------------------------------

_CUT, _OTHER = "elapsed_time % 13 = 12", "elapsed_time % 11 = 10"
_TRAFFIC = f"NOT ({_CUT}) AND NOT ({_OTHER})"
_TRAFFIC_BAD = "dst_port = 22 AND packets_sent % 10 = 0"
_ACTION = "concat(upper(substr(action, 1, 1)), substr(action, 2))"
_PROTO_NAME = "CASE protocol WHEN 6 THEN 'tcp' WHEN 17 THEN 'UDP' WHEN 1 THEN 'icmp' WHEN 47 THEN 'gre' ELSE '99' END"
_DEVICE = "CASE WHEN packets_sent % 2 = 0 THEN concat('DEV-', device_name) ELSE device_name END"
_TRAFFIC_KNOWN = {
    "timestamp": "ts",
    "raw_message": "line",
    "device_name": _DEVICE,
    "serial": "'0001'",
    "log_type": "'TRAFFIC'",
    "log_subtype": "'end'",
    "generated_time": "ts",
    "received_time": "ts",
    "session_id": "bytes_received",
    "src_ip": f"CASE WHEN {_TRAFFIC_BAD} THEN '0.0.0.0' ELSE src_ip END",
    "src_port": "src_port",
    "src_interface": "concat('eth', CAST(src_port % 4 AS VARCHAR))",
    "src_user": "src_user",
    "dst_ip": "dst_ip",
    "dst_port": "dst_port",
    "dst_interface": "concat('eth', CAST(dst_port % 4 AS VARCHAR))",
    "rule_name": "rule_name",
    "rule_uuid": "'uuid-1'",
    "application": "application",
    "app_category": "app_category",
    "protocol": "protocol",
    "ip_protocol": _PROTO_NAME,
    "action": _ACTION,
    "bytes_sent": "bytes_sent",
    "bytes_received": "bytes_received",
    "packets_sent": "CASE WHEN packets_sent % 2 = 0 THEN packets_sent + 100 ELSE packets_sent END",
    "packets_received": "CASE WHEN packets_sent % 3 = 0 THEN 0 ELSE 5 END",
    "session_start_time": f"CASE WHEN packets_sent = 8 THEN {AS_OF} ELSE ts END",
    "elapsed_time": "elapsed_time",
    "src_country": "src_country",
    "dst_country": "dst_country",
    "sequence_number": "bytes_sent",
    "tunnel_type": "CASE WHEN packets_sent % 4 = 0 THEN 'IPSec' ELSE 'N/A' END",
    "parent_start_time": AS_OF,
}
TRAFFIC_SQL = (
    f"SELECT {_expected(TRAFFIC_COLUMNS, _TRAFFIC_KNOWN)}, "
    f"CASE WHEN {_TRAFFIC_BAD} THEN '10.11.40.' ELSE src_ip END AS src_ip_raw, dst_ip AS dst_ip_raw "
    f"FROM traffic_lines WHERE {_TRAFFIC}"
)


@query("parse_pan_traffic", on_lines("traffic_lines", TRAFFIC_SQL))
def parse_pan_traffic(spark, sf_dir):
    return positional.parse_traffic(landed(spark, sf_dir, "traffic"), fx.AS_OF)


@query("parse_pan_slim", on_lines("traffic_lines", f"""
SELECT ts AS timestamp, line AS raw_message, device_name AS devname, CASE WHEN {_TRAFFIC_BAD} THEN '0.0.0.0' ELSE src_ip END AS srcip,
  src_port AS srcport, concat('eth', CAST(src_port % 4 AS VARCHAR)) AS srcintf, dst_ip AS dstip, dst_port AS dstport,
  concat('eth', CAST(dst_port % 4 AS VARCHAR)) AS dstintf, action, rule_name AS policyname, CAST(protocol AS SMALLINT) AS proto,
  app_category AS appcat, src_country AS dstcountry, bytes_received AS sentbyte, CAST(packets_sent AS BIGINT) AS rcvdbyte,
  CAST(CASE WHEN packets_sent % 2 = 0 THEN packets_sent + 100 ELSE 0 END AS BIGINT) AS sentpkt, CAST(0 AS BIGINT) AS rcvdpkt,
  src_user AS username, CASE WHEN {_TRAFFIC_BAD} THEN '10.11.40.' ELSE src_ip END AS srcip_raw, dst_ip AS dstip_raw
FROM traffic_lines WHERE {_TRAFFIC}"""))
def parse_pan_slim(spark, sf_dir):
    return positional.parse_slim(landed(spark, sf_dir, "traffic"), fx.AS_OF)


@query("parse_syslog_header", on_lines("traffic_lines", f"""
SELECT line, CASE WHEN {_CUT} THEN 'Jan' ELSE strftime(ts, '%b') END AS month,
  CASE WHEN {_CUT} THEN '1' ELSE CAST(extract(day FROM ts) AS VARCHAR) END AS day,
  CASE WHEN {_CUT} THEN '00:00:00' ELSE strftime(ts, '%H:%M:%S') END AS clock, device_name AS host,
  NOT ({_CUT}) AS has_payload FROM traffic_lines"""))
def parse_syslog_header(spark, sf_dir):
    split = positional.split_header(landed(spark, sf_dir, "traffic"))
    names = ["month", "day", "clock", "host"]
    return split.select(
        "line",
        *[F.get("header", i).alias(n) for i, n in enumerate(names)],
        F.col("payload").isNotNull().alias("has_payload"),
    )


@query("resolve_event_time", on_lines("traffic_lines", f"""
, kv AS ({on_lines('kv_lines', f"SELECT line, {_KV_KNOWN['timestamp']} AS timestamp FROM kv_lines")}),
url AS ({on_lines('url_lines', "SELECT line, date_trunc('second', ts) AS timestamp FROM url_lines WHERE session_id % 17 <> 16 AND session_id % 13 <> 12")})
SELECT 'kv' AS kind, line, timestamp FROM kv UNION ALL SELECT 'url', line, timestamp FROM url
UNION ALL SELECT 'traffic', line, ts FROM traffic_lines WHERE {_TRAFFIC}
UNION ALL SELECT 'slim', line, ts FROM traffic_lines WHERE {_TRAFFIC}"""))
def resolve_event_time(spark, sf_dir):
    """The event time that each of the four line formats resolves to."""
    kv = kv_parser.parse_kv_typed(landed(spark, sf_dir, "kv"), fx.AS_OF)
    urls = positional.parse_url(landed(spark, sf_dir, "url"), fx.URL_AS_OF)

    def part(kind: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col("raw_message").alias("line"), "timestamp")

    # both forms of a traffic line come from one parse
    times = positional.traffic_times(landed(spark, sf_dir, "traffic"), fx.AS_OF)
    both = times.select("line", F.explode(F.create_map(
        F.lit("traffic"), F.col("timestamp"), F.lit("slim"), F.col("slim_timestamp")
    )).alias("kind", "timestamp"))
    return part("kv", kv).unionByName(part("url", urls)).unionByName(both.select("kind", "line", "timestamp"))


@query("resolve_device", on_lines("traffic_lines", f"""
, url AS ({on_lines('url_lines', "SELECT line, CASE WHEN session_id % 2 = 0 THEN concat('DEV-', device_name) ELSE device_name END AS device_name FROM url_lines WHERE session_id % 17 <> 16 AND session_id % 13 <> 12")})
SELECT line, {_DEVICE} AS device_name FROM traffic_lines WHERE {_TRAFFIC} UNION ALL SELECT line, device_name FROM url"""))
def resolve_device(spark, sf_dir):
    traffic = positional.parse_traffic(landed(spark, sf_dir, "traffic"), fx.AS_OF)
    urls = positional.parse_url(landed(spark, sf_dir, "url"), fx.URL_AS_OF)
    return traffic.select(F.col("raw_message").alias("line"), "device_name").unionByName(
        urls.select(F.col("raw_message").alias("line"), "device_name")
    )


_OUTCOME = f"CASE WHEN {_CUT} THEN 'error' WHEN {_OTHER} THEN 'skipped' ELSE 'parsed' END"
_URL_OUTCOME = "CASE WHEN session_id % 17 = 16 THEN 'error' WHEN session_id % 13 = 12 THEN 'skipped' ELSE 'parsed' END"


@query("route_log_type", on_lines("traffic_lines", f"""
, url AS ({on_lines('url_lines', f"SELECT line, {_URL_OUTCOME} AS as_url, CASE WHEN session_id % 17 = 16 THEN 'error' WHEN session_id % 13 = 12 THEN 'parsed' ELSE 'skipped' END AS as_traffic FROM url_lines")})
SELECT line, {_OUTCOME} AS as_traffic, CASE WHEN {_CUT} THEN 'error' ELSE 'skipped' END AS as_url FROM traffic_lines
UNION ALL SELECT line, as_traffic, as_url FROM url"""))
def route_log_type(spark, sf_dir):
    """One feed of both formats, and what each parser makes of its lines."""
    feed = landed(spark, sf_dir, "traffic").unionByName(landed(spark, sf_dir, "url"))
    split = positional.split_header(feed)
    return split.select(
        "line",
        positional.traffic_outcome(F.col("payload")).alias("as_traffic"),
        positional.url_outcome(F.col("payload")).alias("as_url"),
    )


@query("ingest_stats", on_lines("traffic_lines", f"""
SELECT device_name, count(*) AS total_lines, CAST(count_if(outcome = 'parsed') AS BIGINT) AS parsed, CAST(count_if(outcome = 'skipped') AS BIGINT) AS skipped,
  CAST(count_if(outcome = 'error') AS BIGINT) AS errors, CAST(count_if(outcome = 'parsed' AND NOT ({_TRAFFIC_BAD})) AS BIGINT) AS inserted,
  CASE WHEN count_if(outcome <> 'skipped') > 0 THEN CAST(count_if(outcome = 'parsed') AS DOUBLE) / count_if(outcome <> 'skipped') * 100 ELSE 0 END AS success_pct
FROM (SELECT *, {_OUTCOME} AS outcome FROM traffic_lines) GROUP BY device_name"""))
def ingest_stats(spark, sf_dir):
    """Counters per sending device."""
    lines = positional.with_traffic_fields(landed(spark, sf_dir, "traffic"))
    inserted = net.is_ipv4(F.get("fields", 7)) & net.is_ipv4(F.get("fields", 8))
    return validate.ingest_stats(
        lines.withColumn("device_name", F.get("header", 3)), ["device_name"], inserted
    )


@query("parse_rate", on_lines("traffic_lines", f"""
SELECT device_name, CAST(count_if({_OUTCOME} = 'parsed') AS BIGINT) AS parsed,
  CASE WHEN max(epoch(ts)) > min(epoch(ts)) THEN CAST(count_if({_OUTCOME} = 'parsed') AS DOUBLE) / CAST(floor(max(epoch(ts))) - floor(min(epoch(ts))) AS BIGINT) ELSE 0 END AS lines_per_second
FROM traffic_lines WHERE {_TRAFFIC} GROUP BY device_name"""))
def parse_rate(spark, sf_dir):
    """Parsed lines per second of logged time, by the host that sent them."""
    rows = positional.parse_traffic(landed(spark, sf_dir, "traffic"), fx.AS_OF)
    host = F.regexp_replace("device_name", "^DEV-", "").alias("device_name")
    seconds = F.unix_timestamp(F.max("timestamp").cast("timestamp")) - F.unix_timestamp(F.min("timestamp").cast("timestamp"))
    counted = rows.groupBy(host).agg(F.count(F.lit(1)).alias("parsed"), seconds.alias("seconds"))
    return counted.select(
        "device_name", "parsed", validate.parse_rate(F.col("parsed"), F.col("seconds")).alias("lines_per_second")
    )


# --- web-access lines -------------------------------------------------------------------------

_URL_LINE = "session_id % 17 <> 16 AND session_id % 13 <> 12"
_SECOND = "date_trunc('second', ts)"
_FULL_URL = "concat(url, CASE WHEN session_id % 4 = 0 THEN ',a&b=1' ELSE '' END)"
_PATH = r"regexp_extract({0}, '^[a-z]+://[^/?#]+([^?#]*)', 1)"
_QUERY = r"regexp_extract({0}, '^[^?#]*[?]([^#]*)', 1)"
_FRAGMENT = r"regexp_extract({0}, '#(.*)$', 1)"
_URL_KNOWN = {
    "timestamp": _SECOND,
    "receive_time": _SECOND,
    "generated_time": f"CASE WHEN session_id % 19 = 18 THEN {URL_AS_OF} ELSE {_SECOND} END",
    "processing_timestamp": URL_AS_OF,
    "sequence_number": "session_id + 7",
    "session_id": "session_id",
    "device_name": "CASE WHEN session_id % 2 = 0 THEN concat('DEV-', device_name) ELSE device_name END",
    "serial_number": "'S01'",
    "source_address": "source_address",
    "destination_address": "destination_address",
    "source_port": "40000",
    "destination_port": "CASE WHEN session_id % 5 = 0 THEN 0 ELSE 443 END",
    "ip_protocol": "6",
    "protocol": "'tcp'",
    "url": _FULL_URL,
    "url_domain": "url_domain",
    "url_path": _PATH.format(_FULL_URL),
    "url_query": _QUERY.format(_FULL_URL),
    "url_category": "url_category",
    "url_category_list": "'a,b'",
    "http_method": "http_method",
    "user_agent": "concat(user_agent, ' (X11, Linux)')",
    "content_type": "CASE WHEN session_id % 3 = 0 THEN 'text/html' ELSE 'a\"b' END",
    "rule_name": "rule_name",
    "rule_uuid": "'uuid-2'",
    "action": "action",
    "severity": "'informational'",
    "direction": "'client-to-server'",
    "source_user": "source_user",
    "application": "application",
    "source_country": "'Here'",
    "raw_message": "line",
    "log_type": "'THREAT'",
    "log_subtype": "'url'",
    "virtual_system": "'vsys1'",
}


@query("parse_pan_url", on_lines("url_lines", f"""
SELECT {_expected(URL_COLUMNS, _URL_KNOWN)}, CASE WHEN source_user = '' THEN '' WHEN session_id % 2 = 0 THEN 'CORP' ELSE 'corp' END AS source_user_domain,
  '' AS destination_user_domain, {_SECOND} + INTERVAL '250' MILLISECOND AS high_resolution_timestamp,
  {_FRAGMENT.format(_FULL_URL)} AS url_fragment, regexp_extract(url, '^([a-z]+):', 1) AS url_scheme,
  CASE regexp_extract(url, '^([a-z]+):', 1) WHEN 'https' THEN 443 ELSE 80 END AS url_port
FROM url_lines WHERE {_URL_LINE}"""))
def parse_pan_url(spark, sf_dir):
    return positional.parse_url(landed(spark, sf_dir, "url"), fx.URL_AS_OF)


_FIELD_TEXT = fx.URL_FIELDS | {
    0: "'1'", 31: _FULL_URL, 45: "concat(user_agent, ' (X11, Linux)')", 48: "''", 74: "'a,b'",
}
_JOINED = ", ".join(_FIELD_TEXT.get(i, "''") for i in range(fx.URL_LAST_FIELD))
_BLANK = "''"
_WIDE_NAMES = [n for i, n in URL_POSITIONS if n not in URL_COLUMNS and n != "high_resolution_timestamp"]


@query("parse_pan_url_wide", on_lines("url_lines", "SELECT line, " + ", ".join(
    f"coalesce(nullif({_FIELD_TEXT.get(i, _BLANK)}, ''), '') AS {n}" for i, n in dict((n, (i, n)) for i, n in URL_POSITIONS if n in _WIDE_NAMES).values()
) + f" FROM url_lines WHERE {_URL_LINE}"))
def parse_pan_url_wide(spark, sf_dir):
    """The positions of a web-access line beyond the columns of the table, as text."""
    rows = positional.parse_url(landed(spark, sf_dir, "url"), fx.URL_AS_OF, wide=True)
    names = list(dict.fromkeys(_WIDE_NAMES))
    return rows.select(F.col("raw_message").alias("line"), *names)


@query("parse_hires_ts", on_lines("url_lines", f"""
SELECT line, {_SECOND} + INTERVAL '250' MILLISECOND AS high_resolution_timestamp FROM url_lines WHERE {_URL_LINE}"""))
def parse_hires_ts(spark, sf_dir):
    rows = positional.parse_url(landed(spark, sf_dir, "url"), fx.URL_AS_OF)
    return rows.select(F.col("raw_message").alias("line"), "high_resolution_timestamp")


@query("csv_split_quoted", on_lines("url_lines", f"""
SELECT line, CAST(CASE WHEN session_id % 17 = 16 THEN NULL ELSE {fx.URL_LAST_FIELD} END AS INTEGER) AS n_fields,
  CASE WHEN session_id % 17 <> 16 THEN concat_ws('|', {_JOINED}) END AS joined FROM url_lines"""))
def csv_split_quoted(spark, sf_dir):
    fields = text.split_quoted(F.col("payload"))
    split = positional.split_header(landed(spark, sf_dir, "url")).withColumn("fields", fields)
    return split.select(
        "line",
        F.when(F.col("fields").isNotNull(), F.size("fields")).alias("n_fields"),
        F.array_join("fields", "|").alias("joined"),
    )


# --- URLs, users, protocols, times ------------------------------------------------------------

_FORMS_CTE = f"forms AS ({_plain(fx.URL_FORMS, urls='urls')})"
_FORM = "session_id % 8"


def _on_forms(sql: str) -> str:
    return on_urls(f", {_FORMS_CTE} {sql}")


_IP_HOST = "concat('10.1.', CAST(session_id % 250 AS VARCHAR), '.7:2121')"
_FORM_DOMAIN = (f"CASE WHEN {_FORM} = 7 THEN '' WHEN {_FORM} = 2 THEN concat(plain_domain, ':8080') "
                f"WHEN {_FORM} = 3 THEN concat('me@', plain_domain) WHEN {_FORM} = 6 THEN {_IP_HOST} ELSE plain_domain END")
_FORM_SCHEME = (f"CASE WHEN {_FORM} IN (1, 7) THEN '' WHEN {_FORM} = 2 THEN 'https' WHEN {_FORM} = 6 THEN 'ftp' "
                "ELSE regexp_extract(plain_url, '^([a-z]+):', 1) END")
_PLUS = f"concat(plain_url, CASE WHEN {_FORM} = 4 THEN '&b=&c=1&c=2' WHEN {_FORM} = 5 THEN repeat('x', 2100) ELSE '' END)"


def _by_form(plain: str, sixth: str) -> str:
    return f"CASE WHEN {_FORM} = 7 THEN '' WHEN {_FORM} = 6 THEN '{sixth}' ELSE {plain} END"


_FORM_PATH = _by_form(_PATH.format(_PLUS), "/a//b")
_FORM_QUERY = _by_form(_QUERY.format(_PLUS), "q=%20a&q=2")


def _forms(spark, sf_dir) -> DataFrame:
    forms = fx.url_forms(spark, sf_dir).select("session_id", "url")
    return url.with_url_parts(forms)


@query("url_decompose", _on_forms(f"""
SELECT session_id, CASE WHEN {_FORM} = 7 THEN '' ELSE url END AS url, {_FORM_DOMAIN} AS url_domain, {_FORM_PATH} AS url_path,
  {_FORM_QUERY} AS url_query, {_by_form(_FRAGMENT.format(_PLUS), '')} AS url_fragment, {_FORM_SCHEME} AS url_scheme FROM forms"""))
def url_decompose(spark, sf_dir):
    return _forms(spark, sf_dir).drop("url_port")


@query("url_port", _on_forms(f"""
SELECT session_id, CASE WHEN {_FORM} IN (1, 7) THEN 0 WHEN {_FORM} = 2 THEN 8080 WHEN {_FORM} = 6 THEN 2121
  WHEN starts_with(plain_url, 'https:') THEN 443 ELSE 80 END AS url_port FROM forms"""))
def url_port(spark, sf_dir):
    return _forms(spark, sf_dir).select("session_id", "url_port")


@query("url_domain_risk", _on_forms(f"""
, hosts AS (SELECT session_id, CASE session_id % 5 WHEN 0 THEN concat('1.2.3.', CAST(session_id % 256 AS VARCHAR)) WHEN 1 THEN concat('a1b2c3d4', plain_domain)
  WHEN 2 THEN concat(plain_domain, '.TK') ELSE plain_domain END AS host FROM forms)
SELECT session_id, host, CASE WHEN session_id % 5 = 0 THEN 'ip' ELSE 'domain' END AS domain_type,
  CASE WHEN session_id % 5 IN (0, 1, 2) THEN 'yes' ELSE 'no' END AS domain_suspicious FROM hosts"""))
def url_domain_risk(spark, sf_dir):
    number, domain = F.col("session_id"), F.col("plain_domain")
    host = (
        F.when(number % 5 == 0, F.concat(F.lit("1.2.3."), (number % 256).cast("string")))
        .when(number % 5 == 1, F.concat(F.lit("a1b2c3d4"), domain))
        .when(number % 5 == 2, F.concat(domain, F.lit(".TK")))
        .otherwise(domain)
    )
    hosts = fx.url_forms(spark, sf_dir).select("session_id", host.alias("host"))
    return hosts.withColumns(
        {
            "domain_type": url.domain_type(F.col("host")),
            "domain_suspicious": url.domain_suspicious(F.col("host")),
        }
    )


@query("url_path_query_stats", _on_forms(f"""
SELECT session_id, CAST(len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS INTEGER) AS path_depth,
  CAST(len(list_distinct(list_transform(list_filter(string_split(query, '&'), lambda x: regexp_matches(x, '^[^=]*=.')), lambda x: split_part(x, '=', 1)))) AS INTEGER) AS query_params
FROM (SELECT session_id, {_FORM_PATH} AS path, {_FORM_QUERY} AS query FROM forms)"""))
def url_path_query_stats(spark, sf_dir):
    return _forms(spark, sf_dir).select(
        "session_id",
        url.path_depth(F.col("url_path")).alias("path_depth"),
        url.query_param_count(F.col("url_query")).alias("query_params"),
    )


@query("url_category_rollup", on_urls("""
SELECT CASE url_category WHEN 'news' THEN 'news-media' WHEN 'search-engines' THEN 'web-search' WHEN 'business-and-economy' THEN 'business'
  WHEN 'social-networking' THEN 'social-media' ELSE url_category END AS category_group, count(*) AS requests FROM urls GROUP BY ALL"""))
def url_category_rollup(spark, sf_dir):
    group = url.category_group(F.col("url_category")).alias("category_group")
    return fx.urls(spark, sf_dir).groupBy(group).agg(F.count(F.lit(1)).alias("requests"))


@query("split_user_domain", on_urls("""
SELECT session_id, source_user AS user_name, CASE WHEN source_user = '' OR session_id % 3 = 2 THEN '' WHEN session_id % 3 = 0 THEN 'CORP' ELSE 'corp' END AS user_domain
FROM urls"""))
def split_user_domain(spark, sf_dir):
    raw, plain = F.col("source_user_raw"), F.col("source_user")
    user = (
        F.when(F.col("session_id") % 3 == 0, F.replace(raw, F.lit("#"), F.lit("\\")))
        .when((F.col("session_id") % 3 == 1) & (plain != ""), F.concat(plain, F.lit("@corp")))
        .otherwise(plain)
    )
    return fx.urls(spark, sf_dir).select(
        "session_id", text.user_name(user).alias("user_name"), text.user_domain(user).alias("user_domain")
    )


@query("proto_to_number", on_flows(f"""
SELECT ts, src_ip, {_PROTO_NAME} AS name, protocol AS number FROM flows"""))
def proto_to_number(spark, sf_dir):
    number = F.col("protocol")
    name = (
        F.when(number == 6, "tcp").when(number == 17, "UDP").when(number == 1, "icmp")
        .when(number == 47, "gre").otherwise("99")
    )
    rows = fx.flows(spark, sf_dir).select("ts", "src_ip", name.alias("name"))
    return rows.withColumn("number", net.protocol_number(F.col("name")))


@query("proto_to_name", on_flows("""
SELECT ts, src_ip, protocol, CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' WHEN 47 THEN 'GRE' ELSE '99' END AS label FROM flows"""))
def proto_to_name(spark, sf_dir):
    label = net.protocol_label(F.col("protocol")).alias("label")
    return fx.flows(spark, sf_dir).select("ts", "src_ip", "protocol", label)


@query("derive_time_columns", on_urls("""
SELECT session_id, CAST(ts AS DATE) AS log_date, date_trunc('hour', ts) AS log_hour, strftime(ts, '%H:%M:%S') AS log_time,
  CAST(strftime(ts, '%Y%m') AS INTEGER) AS ym FROM urls"""))
def derive_time_columns(spark, sf_dir):
    return times.with_time_columns(fx.urls(spark, sf_dir).select("session_id", "ts"), "ts").drop("ts")
