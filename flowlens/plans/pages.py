"""Queries behind the summary, log, web-access and grouped pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions import fmt
from flowlens.operators import display, distinct, grouping, paging, rollups, summary, unify
from flowlens.operators.filters import (
    EXTERNAL_ONLY,
    PRESETS,
    FilterSpec,
    TimeWindow,
    UrlFilterSpec,
    custom_window,
    preset_window,
)
from flowlens.plans import fixtures as fx
from flowlens.plans.registry import on_flows, on_unified, on_urls, query
from flowlens.session import scratch_dir

# The whole span of the derived flows.
ALL_TIME = TimeWindow(datetime(1995, 1, 1), datetime(2002, 1, 1))
IN_ALL_TIME = "ts >= TIMESTAMP '1995-01-01' AND ts <= TIMESTAMP '2002-01-01'"

ROW = ["ts", "src_ip", "src_port", "dst_ip", "dst_port", "action", "protocol", "bytes_sent",
       "bytes_received", "elapsed_time", "device_name", "src_user"]
ROW_SQL = ", ".join(ROW)


def _windowed(spark, sf_dir) -> DataFrame:
    rows = fx.flows(spark, sf_dir, ALL_TIME.since, ALL_TIME.until)
    return FilterSpec(window=ALL_TIME, include_threats=True).apply(rows, "ts")


def _unified(spark, sf_dir) -> DataFrame:
    return unify.union_sources(fx.source_tables(spark, sf_dir))


# --- summary page -----------------------------------------------------------------------------

@query("top_flows", on_flows(f"""
SELECT src_ip, dst_ip, dst_port, CAST(sum(bytes_sent) AS BIGINT) AS total_sent, CAST(sum(bytes_received) AS BIGINT) AS total_received,
  CAST(sum(bytes_sent + bytes_received) AS BIGINT) AS total_bytes
FROM flows WHERE {IN_ALL_TIME} GROUP BY src_ip, dst_ip, dst_port ORDER BY total_bytes DESC, src_ip, dst_ip, dst_port LIMIT 10"""))
def top_flows(spark, sf_dir):
    return summary.top_flows(_windowed(spark, sf_dir))


def _top_values(name: str, column: str) -> None:
    sql = f"""SELECT {column}, count(*) AS events, CAST(sum(bytes_sent + bytes_received) AS BIGINT) AS total_bytes
FROM flows WHERE {IN_ALL_TIME} AND coalesce({column}, '') <> '' GROUP BY {column} ORDER BY events DESC, {column} LIMIT 10"""
    query(name, on_flows(sql))(lambda s, d: summary.top_values(_windowed(s, d), column))


_top_values("top_categories", "app_category")
_top_values("top_hosts", "hostname")
_top_values("top_users", "src_user")
_top_values("top_countries", "dst_country")

_PANEL_SQL = " UNION ALL ".join(
    f"SELECT '{panel}' AS panel, {column} AS value, bytes_sent + bytes_received AS size FROM flows WHERE {IN_ALL_TIME}"
    for panel, column in summary.PANELS.items()
)


@query("summary_panels", on_flows(f"""
SELECT panel, CAST(rank AS INTEGER) AS rank, value, events, total_bytes FROM (
  SELECT panel, value, count(*) AS events, CAST(sum(size) AS BIGINT) AS total_bytes,
    row_number() OVER (PARTITION BY panel ORDER BY count(*) DESC, value) AS rank
  FROM ({_PANEL_SQL}) WHERE coalesce(value, '') <> '' GROUP BY panel, value) WHERE rank <= 10"""))
def summary_panels(spark, sf_dir):
    return summary.summary_panels(_windowed(spark, sf_dir))


@query("summary_totals", on_flows(f"""
SELECT count(*) AS total_connections, CAST(coalesce(sum(bytes_sent + bytes_received), 0) AS BIGINT) AS total_bytes,
  count(DISTINCT src_ip) AS active_ips FROM flows WHERE {IN_ALL_TIME}"""))
def summary_totals(spark, sf_dir):
    return summary.summary_totals(_windowed(spark, sf_dir))


@query("top_from_sketches", on_flows(f"""
SELECT panel, CAST(rank AS INTEGER) AS rank, value, events, true AS close FROM (
  SELECT panel, value, count(*) AS events, row_number() OVER (PARTITION BY panel ORDER BY count(*) DESC, value) AS rank
  FROM ({_PANEL_SQL}) WHERE coalesce(value, '') <> '' GROUP BY panel, value) WHERE rank <= 10"""))
def top_from_sketches(spark, sf_dir):
    """Top lists from hourly sketches that are stored and combined. Exact counts, each beside a flag that the sketches
    name the value with a count within 5 %."""
    rows, path = _windowed(spark, sf_dir), f"{scratch_dir(spark, 'sketches')}/hours"
    summary.top_sketches(rows, [F.date_trunc("HOUR", "ts").alias("hour")]).write.parquet(path)
    estimated = summary.top_from_sketches(spark.read.parquet(path), limit=100).withColumnRenamed("events", "estimate")
    exact = summary.summary_panels(rows).drop("total_bytes")
    close = F.abs(F.col("estimate") - F.col("events")) <= F.greatest(F.lit(1), F.col("events") * 0.05)
    return exact.join(estimated, ["panel", "value"], "left").select(
        "panel", "rank", "value", "events", F.coalesce(close, F.lit(False)).alias("close")
    )


# --- filters ----------------------------------------------------------------------------------

_HOURS = {name: int(span.total_seconds() // 3600) for name, span in PRESETS.items()}


@query("filter_time_preset", on_flows(" UNION ALL ".join(
    f"SELECT '{name}' AS preset, count(*) AS events, CAST(coalesce(sum(bytes_sent + bytes_received), 0) AS BIGINT) AS total_bytes "
    f"FROM flows WHERE ts >= TIMESTAMP '{fx.AS_OF}' - INTERVAL '{hours}' HOUR AND ts <= TIMESTAMP '{fx.AS_OF}'"
    for name, hours in _HOURS.items())))
def filter_time_preset(spark, sf_dir):
    """Events and bytes of every preset, all in one pass over the longest of them."""
    windows = {name: preset_window(name, fx.AS_OF) for name in PRESETS}
    longest = min(windows.values(), key=lambda w: w.since)
    rows = fx.flows(spark, sf_dir, longest.since, longest.until).where(longest.predicate("ts"))
    size = F.col("bytes_sent") + F.col("bytes_received")
    counts = [
        F.struct(
            F.lit(name).alias("preset"),
            F.count_if(window.predicate("ts")).alias("events"),
            F.coalesce(F.sum(F.when(window.predicate("ts"), size)), F.lit(0)).alias("total_bytes"),
        )
        for name, window in windows.items()
    ]
    return rows.agg(F.array(*counts).alias("all")).select(F.inline("all"))


def _filter(name: str, spec: FilterSpec, where: str) -> None:
    spec_window = spec.window

    def run(spark, sf_dir):
        rows = (
            fx.flows(spark, sf_dir, spec_window.since, spec_window.until)
            if spec_window
            else fx.flows(spark, sf_dir)
        )
        return spec.apply(rows, "ts").select(*ROW)

    query(name, on_flows(f"SELECT {ROW_SQL} FROM flows WHERE {where}"))(run)


def _all_sources(**filters: str) -> FilterSpec:
    return FilterSpec(include_threats=True, **filters)


_filter(
    "filter_time_custom",
    FilterSpec(
        window=custom_window("1998-01-01T00:00", "1998-06-30T23:59", fx.AS_OF), include_threats=True
    ),
    "ts >= TIMESTAMP '1998-01-01 00:00:00' AND ts <= TIMESTAMP '1998-06-30 23:59:00'",
)
_filter(
    "filter_equality",
    _all_sources(action="deny", device_name="FW-3", app_category="STANDARD"),
    "action = 'deny' AND device_name = 'FW-3' AND app_category = 'STANDARD'",
)
_filter(
    "filter_ports",
    _all_sources(dst_port="443, 53", src_port="2000-30000"),
    "dst_port IN (443, 53) AND src_port BETWEEN 2000 AND 30000",
)
_filter(
    "filter_external_only",
    _all_sources(src_ip=EXTERNAL_ONLY),
    """NOT (src_ip LIKE '10.%' OR src_ip LIKE '192.168.%' OR src_ip LIKE '169.254.%' OR src_ip = '127.0.0.1' OR """
    + " OR ".join(f"src_ip LIKE '172.{n}.%'" for n in range(16, 32)) + ")",
)
_filter("filter_protocol", _all_sources(protocol="udp"), "protocol = 17")
_filter(
    "search_cs",
    _all_sources(search="user1"),
    " OR ".join(f"contains({c}, 'user1')" for c in FilterSpec.SEARCHED),
)
_filter(
    "filter_bytes_range",
    _all_sources(min_bytes="2000000", max_bytes="5000000"),
    "bytes_sent + bytes_received >= 2000000 AND bytes_sent + bytes_received <= 5000000",
)
_filter(
    "filter_duration_range",
    _all_sources(min_duration="20", max_duration="60"),
    "elapsed_time >= 20 AND elapsed_time <= 60",
)

URL_ROW = ["ts", "url", "url_domain", "url_category", "action", "source_address", "device_name",
           "http_method", "response_code", "source_user", "application", "session_id"]


def _url_filter(name: str, spec: UrlFilterSpec, where: str) -> None:
    query(name, on_urls(f"SELECT {', '.join(URL_ROW)} FROM urls WHERE {where}"))(
        lambda s, d: spec.apply(fx.urls(s, d), "ts").select(*URL_ROW)
    )


_url_filter(
    "search_ci",
    UrlFilterSpec(search="THRE"),
    " OR ".join(f"contains(lower({c}), 'thre')" for c in UrlFilterSpec.SEARCHED),
)
_url_filter(
    "filter_contains_ci",
    UrlFilterSpec(url="PAGE=", source_user="U1", device_name="fw-", application="SSL", action="allow"),
    "contains(lower(url), 'page=') AND contains(lower(source_user), 'u1') AND contains(lower(device_name), 'fw-') "
    "AND contains(lower(application), 'ssl') AND action = 'allow'",
)

UNIFIED_ROW = "timestamp, src_ip, dst_ip, dst_port, action, bytes_sent, log_source, device_name, hostname"


@query("filter_log_source", on_unified(
    f"SELECT {UNIFIED_ROW} FROM unified WHERE log_source = 'flows_pan'"))
def filter_log_source(spark, sf_dir):
    rows = FilterSpec(log_source="flows_pan").apply(_unified(spark, sf_dir))
    return rows.select(*UNIFIED_ROW.split(", "))


@query("filter_unified", on_unified(
    f"SELECT {UNIFIED_ROW} FROM unified WHERE log_source <> 'threats' AND action = 'accept' AND dst_port = 443 AND src_user <> '' "
    "AND (contains(src_ip, '10.1') OR contains(dst_ip, '10.1') OR contains(hostname, '10.1') OR contains(src_user, '10.1') OR contains(app_category, '10.1'))"))
def filter_unified(spark, sf_dir):
    spec = FilterSpec(action="accept", dst_port="443", search="10.1")
    rows = spec.apply(_unified(spark, sf_dir)).where(F.col("src_user") != "")
    return rows.select(*UNIFIED_ROW.split(", "))


# --- sources side by side ---------------------------------------------------------------------

@query("unify_project", on_unified("SELECT * FROM unified WHERE log_source = 'flows_kv'"))
def unify_project(spark, sf_dir):
    return unify.unify_project(fx.source_tables(spark, sf_dir)["flows_kv"], "flows_kv")


@query("union_sources", on_unified("SELECT * FROM unified"))
def union_sources(spark, sf_dir):
    return _unified(spark, sf_dir)


@query("union_available", on_unified("SELECT * FROM unified WHERE log_source <> 'threats'"))
def union_available(spark, sf_dir):
    """Two of the three tables exist here; the third is left out."""
    tables = {source: f"flowlens_{source}" for source in ("flows_kv", "flows_pan", "threats")}
    frames = fx.source_tables(spark, sf_dir)
    spark.catalog.dropTempView(tables["threats"])
    for source in ("flows_kv", "flows_pan"):
        frames[source].createOrReplaceTempView(tables[source])
    return unify.union_available(spark, tables)


@query("count_by_source", on_flows("SELECT log_source, count(*) AS events FROM flows GROUP BY log_source"))
def count_by_source(spark, sf_dir):
    return summary.count_by_source(_unified(spark, sf_dir))


@query("facet_actions", on_flows("SELECT DISTINCT action FROM flows"))
def facet_actions(spark, sf_dir):
    return summary.facet(_unified(spark, sf_dir), "action")


@query("facet_devices", on_flows("SELECT DISTINCT device_name FROM flows"))
def facet_devices(spark, sf_dir):
    return summary.facet(_unified(spark, sf_dir), "device_name")


def _facet_sql(view: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT DISTINCT '{c}' AS facet, {c} AS value FROM {view} WHERE {c} <> ''" for c in columns
    )


URL_FACETS = ["url_category", "action", "device_name", "http_method", "application"]


@query("facets_url", on_urls(_facet_sql("urls", URL_FACETS)))
def facets_url(spark, sf_dir):
    return summary.facets(fx.urls(spark, sf_dir), URL_FACETS)


@query("facets_url_filtered", on_urls(f", kept AS (SELECT * FROM urls WHERE action = 'allow' AND http_method = 'GET') {_facet_sql('kept', URL_FACETS)}"))
def facets_url_filtered(spark, sf_dir):
    """The choices that the current filter leaves."""
    spec = UrlFilterSpec(action="allow", http_method="GET")
    return summary.facets(fx.urls(spark, sf_dir).where(spec.predicate("ts")), URL_FACETS)


@query("facets_grouped", on_flows(_facet_sql("flows", ["action", "device_name"])))
def facets_grouped(spark, sf_dir):
    return summary.facets(fx.flows(spark, sf_dir), ["action", "device_name"])


# --- log and web-access pages -----------------------------------------------------------------

FLOW_ORDER_SQL = (
    "ts DESC, device_name, src_ip, src_port, dst_ip, dst_port, action, protocol, bytes_received, "
    "bytes_sent, packets_sent, packets_received, elapsed_time, rule_name, src_user, app_category, "
    "application, hostname, dst_country, src_country, log_source"
)


@query("latest_rows", on_flows(f"SELECT * FROM flows ORDER BY {FLOW_ORDER_SQL} LIMIT 5"))
def latest_rows(spark, sf_dir):
    return paging.latest_rows(fx.flows(spark, sf_dir), 5, "ts")


_TIMELESS = "CASE WHEN action = 'deny' THEN NULL ELSE ts END"


@query("logs_page_timeless", on_flows(f"""
SELECT * FROM (SELECT {_TIMELESS} AS ts, * EXCLUDE (ts) FROM flows) ORDER BY {FLOW_ORDER_SQL.replace('ts DESC', 'ts DESC NULLS LAST')} LIMIT 50
OFFSET (SELECT CAST(floor(count(*) / 50.0) * 50 AS BIGINT) FROM flows WHERE action <> 'deny')"""))
def logs_page_timeless(spark, sf_dir):
    """The page on which rows without a time begin."""
    rows = fx.flows(spark, sf_dir).withColumn("ts", F.when(F.col("action") != "deny", F.col("ts")))
    timed = rows.where(F.col("ts").isNotNull()).count()
    return paging.newest_page(rows, timed // 50 + 1, ts="ts")


def page_label_sql(x: str, zero: bool = True) -> str:
    steps = " ".join(
        f"WHEN {x} < {1024 ** (p + 1)} THEN printf('%.1f {fmt.UNITS[p]}', {x} / {float(1024 ** p)!r})"
        for p in range(5)
    )
    start = f"WHEN coalesce({x}, 0) = 0 THEN '0 B' " if zero else ""
    return f"CASE {start}{steps} ELSE printf('%.1f PB', {x} / {float(1024 ** 5)!r}) END"


def url_label_sql(x: str) -> str:
    steps = " ".join(
        f"WHEN {x} < {1024 ** (p + 1)} THEN concat(CAST(round_even({x} / {float(1024 ** p)!r}, 2) AS VARCHAR), ' {fmt.UNITS[p]}')"
        for p in range(4)
    )
    return f"CASE WHEN {x} = 0 THEN '0 B' {steps} ELSE concat(CAST(round_even({x} / {float(1024 ** 4)!r}, 2) AS VARCHAR), ' TB') END"


def humanize_sql(x: str) -> str:
    steps = " ".join(
        f"WHEN {x} < {1024 ** (p + 1)} THEN printf('%.{2 if p else 0}f {fmt.UNITS[p]}', {x} / {float(1024 ** p)!r})"
        for p in range(4)
    )
    return f"CASE {steps} ELSE printf('%.2f TB', {x} / {float(1024 ** 4)!r}) END"


# Labels of protocols.
PROTOCOL_SQL = ("CASE protocol WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 47 THEN 'GRE' WHEN 50 THEN 'ESP' "
                "WHEN 51 THEN 'AH' WHEN 58 THEN 'ICMPv6' ELSE CAST(protocol AS VARCHAR) END")


@query("log_display_rows", on_unified(f"""
SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS ts_display, action, src_ip AS srcip, src_port AS srcport, dst_ip AS dstip,
  dst_port AS dstport, {PROTOCOL_SQL} AS proto_label, {page_label_sql('bytes_received')} AS rcvdbyte_label,
  {page_label_sql('bytes_sent')} AS sentbyte_label, elapsed_time AS duration_ms, concat(CAST(elapsed_time AS VARCHAR), 'ms') AS duration_label,
  packets_sent AS sentpkt, packets_received AS rcvdpkt, src_interface AS srcintf, dst_interface AS dstintf, rule_name AS policyname,
  raw_message, log_source, src_user AS username, src_country AS srccountry, dst_country AS dstcountry, device_name, application,
  threat_id, severity FROM unified"""))
def log_display_rows(spark, sf_dir):
    return display.log_display_rows(_unified(spark, sf_dir))


def _or_na(column: str, missing: str = "N/A") -> str:
    return f"coalesce(nullif({column}, ''), '{missing}') AS {column}"


_URL_TEXT = ["url", "url_domain", "action", "source_address", "destination_address", "device_name",
             "http_method", "user_agent", "source_user", "rule_name", "application"]


@query("url_display_rows", on_urls(f"""
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, {', '.join(_or_na(c) for c in _URL_TEXT)}, {_or_na('url_category', 'uncategorized')},
  response_code, bytes_sent, bytes_received, bytes_sent + bytes_received AS total_bytes,
  {url_label_sql('bytes_sent')} AS bytes_sent_label, {url_label_sql('bytes_received')} AS bytes_received_label,
  {url_label_sql('(bytes_sent + bytes_received)')} AS total_bytes_label, raw_message FROM urls"""))
def url_display_rows(spark, sf_dir):
    return display.url_display_rows(fx.urls(spark, sf_dir), "ts")


@query("duration_bar", on_flows(f"""
SELECT {ROW_SQL}, greatest(10.0::DOUBLE, elapsed_time / greatest((SELECT max(elapsed_time) FROM flows), 100) * 80) AS bar_width FROM flows"""))
def duration_bar(spark, sf_dir):
    return display.duration_bar(fx.flows(spark, sf_dir)).select(*ROW, "bar_width")


# --- byte labels ------------------------------------------------------------------------------

# Sizes from nothing to petabytes, made from the counters of the flows.


def _sizes(spark, sf_dir) -> DataFrame:
    c, a, b = F.col("packets_sent").cast("bigint"), F.col("bytes_sent"), F.col("bytes_received")
    size = (
        F.when(c % 6 == 0, F.lit(0))
        .when(c % 6 == 1, b)
        .when(c % 6 == 2, a)
        .when(c % 6 == 3, a * 1000)
        .when(c % 6 == 4, a * 1048576)
        .otherwise(b * 1073741824)
    )
    return fx.flows(spark, sf_dir).select(size.cast("bigint").alias("size"))


SIZES_SQL = """(SELECT CAST(CASE packets_sent % 6 WHEN 0 THEN 0 WHEN 1 THEN bytes_received WHEN 2 THEN bytes_sent
  WHEN 3 THEN bytes_sent * 1000 WHEN 4 THEN bytes_sent * 1048576 ELSE bytes_received * 1073741824 END AS BIGINT) AS size FROM flows)"""


def _label(name: str, function, sql: str) -> None:
    query(name, on_flows(f"SELECT size, {sql} AS label FROM {SIZES_SQL}"))(
        lambda s, d: _sizes(s, d).select("size", function(F.col("size")).alias("label"))
    )


_label("fmt_bytes_page", fmt.bytes_page, page_label_sql("size"))
_label("fmt_bytes_url", fmt.bytes_url, url_label_sql("size"))
_label("fmt_bytes_humanize", fmt.bytes_humanize, humanize_sql("size"))
_label("fmt_bytes_monitor", fmt.bytes_one_decimal, page_label_sql("size", zero=False))


# --- grouped page -----------------------------------------------------------------------------

FLOW_GROUPS_SQL = """SELECT src_ip, dst_ip, dst_port, action, count(*) AS event_count, CAST(sum(bytes_sent) AS BIGINT) AS total_sent,
  CAST(sum(bytes_received) AS BIGINT) AS total_received, min(protocol) AS protocol, max(ts) AS last_seen
FROM flows GROUP BY src_ip, dst_ip, dst_port, action"""
SUBNET_SQL = f"""SELECT src_subnet, dst_ip, dst_port, action, CAST(sum(event_count) AS BIGINT) AS event_count,
  CAST(sum(total_sent) AS BIGINT) AS total_sent, CAST(sum(total_received) AS BIGINT) AS total_received, max(last_seen) AS last_seen,
  string_agg(DISTINCT {PROTOCOL_SQL}, ', ' ORDER BY {PROTOCOL_SQL}) AS protocols
FROM (SELECT *, concat(regexp_extract(src_ip, '^([0-9]+[.][0-9]+[.][0-9]+)', 1), '.0/24') AS src_subnet FROM ({FLOW_GROUPS_SQL}))
GROUP BY src_subnet, dst_ip, dst_port, action"""
SUBNET_ORDER = "src_subnet, dst_ip, dst_port, action"


def _flow_groups(spark, sf_dir) -> DataFrame:
    return grouping.flow_groups(fx.flows(spark, sf_dir), "ts")


@query("flow_groups", on_flows(FLOW_GROUPS_SQL))
def flow_groups(spark, sf_dir):
    return _flow_groups(spark, sf_dir)


@query("count_flow_groups", on_flows(f"SELECT count(*) AS flow_groups FROM ({FLOW_GROUPS_SQL})"))
def count_flow_groups(spark, sf_dir):
    return grouping.count_flow_groups(fx.flows(spark, sf_dir))


@query("subnet_rollup", on_flows(SUBNET_SQL))
def subnet_rollup(spark, sf_dir):
    return grouping.subnet_rollup(_flow_groups(spark, sf_dir))


@query("subnet_details", on_flows(f"""
SELECT concat(regexp_extract(src_ip, '^([0-9]+[.][0-9]+[.][0-9]+)', 1), '.0/24') AS src_subnet, dst_ip, dst_port, action,
  CAST(row_number() OVER (PARTITION BY regexp_extract(src_ip, '^([0-9]+[.][0-9]+[.][0-9]+)', 1), dst_ip, dst_port, action
    ORDER BY event_count DESC, src_ip) - 1 AS INTEGER) AS place,
  src_ip, event_count, total_sent, total_received, protocol, last_seen FROM ({FLOW_GROUPS_SQL})"""))
def subnet_details(spark, sf_dir):
    """The nested lists, flattened for the check."""
    nested = grouping.subnet_details(_flow_groups(spark, sf_dir))
    return nested.select(*grouping.SUBNET_KEYS, F.posexplode("details").alias("place", "d")).select(
        *grouping.SUBNET_KEYS, "place", "d.*"
    )


@query("group_slug", on_flows(f"""
SELECT {SUBNET_ORDER}, event_count, {page_label_sql('total_sent')} AS total_sent_label, {page_label_sql('total_received')} AS total_received_label,
  replace(lower(concat('subnetgroup-', replace(replace(src_subnet, '/', '_'), '.', '_'), '-', replace(dst_ip, '.', '_'), '-',
    CAST(dst_port AS VARCHAR), '-', action)), ' ', '_') AS group_id FROM ({SUBNET_SQL})"""))
def group_slug(spark, sf_dir):
    nested = grouping.subnet_details(_flow_groups(spark, sf_dir))
    return nested.select(
        *grouping.SUBNET_KEYS, "event_count", "total_sent_label", "total_received_label", "group_id"
    )


@query("subnet_sorted", on_flows(
    f"SELECT * FROM ({SUBNET_SQL}) ORDER BY event_count DESC, last_seen DESC, {SUBNET_ORDER} LIMIT 50"))
def subnet_sorted(spark, sf_dir):
    groups = grouping.subnet_rollup(_flow_groups(spark, sf_dir))
    return paging.page(groups, grouping.subnet_order("count", "desc"), 1)


@query("subnet_page", on_flows(f"""
SELECT *, (SELECT CAST(ceil(count(*) / 50.0) AS BIGINT) FROM ({SUBNET_SQL})) AS total_pages FROM ({SUBNET_SQL})
ORDER BY last_seen DESC, {SUBNET_ORDER} LIMIT 50
OFFSET (SELECT CAST((ceil(count(*) / 50.0) - 1) * 50 AS BIGINT) FROM ({SUBNET_SQL}))"""))
def subnet_page(spark, sf_dir):
    """A page number far beyond the end gives the last page."""
    groups = grouping.subnet_rollup(_flow_groups(spark, sf_dir))
    found = paging.clamped_page(groups, grouping.subnet_order(), 10**9)
    return found.rows.withColumn("total_pages", F.lit(found.total_pages).cast("bigint"))


@query("subnet_page_middle", on_flows(f"""
SELECT *, (SELECT CAST(ceil(count(*) / 50.0) AS BIGINT) FROM ({SUBNET_SQL})) AS total_pages FROM ({SUBNET_SQL})
ORDER BY last_seen DESC, {SUBNET_ORDER} LIMIT 50 OFFSET 100"""))
def subnet_page_middle(spark, sf_dir):
    groups = grouping.subnet_rollup(_flow_groups(spark, sf_dir))
    found = paging.clamped_page(groups, grouping.subnet_order(), 3)
    return found.rows.withColumn("total_pages", F.lit(found.total_pages).cast("bigint"))


# --- rollups ----------------------------------------------------------------------------------

@query("daily_category_actions", on_urls("""
SELECT CAST(ts AS DATE) AS date, url_category, action, count(*) AS requests, CAST(count_if(action = 'block') AS BIGINT) AS blocked,
  count(DISTINCT source_address) AS unique_users, count(DISTINCT url_domain) AS unique_domains
FROM urls GROUP BY ALL"""))
def daily_category_actions(spark, sf_dir):
    return rollups.daily_category_actions(fx.urls(spark, sf_dir), "ts", exact=True)


def beside_exact(estimated: DataFrame, exact: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """The exact counts beside whether the estimates are within 5 %, or one; other columns as estimated
    frames have them."""
    named = exact.select(*keys, *[F.col(c).alias(f"_{c}") for c in counts])
    joined = estimated.join(named, keys)

    def close(c: str) -> Column:
        return F.abs(F.col(c) - F.col(f"_{c}")) <= F.greatest(F.lit(1.0), 0.05 * F.col(f"_{c}"))

    rest = [c for c in estimated.columns if c not in counts]
    return joined.select(
        *rest, *[F.col(f"_{c}").alias(c) for c in counts], *[close(c).alias(f"{c}_close") for c in counts]
    )


_UNIQ = ["source_address", "url_domain", "source_user"]


@query("uniq_approx", on_urls(f"""
SELECT url_category, action, {', '.join(f"count(DISTINCT {c}) AS uniq_{c}, true AS uniq_{c}_close" for c in _UNIQ)} FROM urls GROUP BY url_category, action"""))
def uniq_approx(spark, sf_dir):
    """Sketched distinct counts, judged against exact ones."""
    by, rows = ["url_category", "action"], fx.urls(spark, sf_dir)
    exact = rows.groupBy(*by).agg(*[F.countDistinct(c).alias(f"uniq_{c}") for c in _UNIQ])
    return beside_exact(rollups.uniq_approx(rows, by, _UNIQ), exact, by, [f"uniq_{c}" for c in _UNIQ])


@query("rollup_url_hourly", on_urls("""
SELECT date_trunc('hour', ts) AS hour, url_category, action, device_name, count(*) AS requests,
  CAST(count_if(action = 'block') AS BIGINT) AS blocked_requests, CAST(count_if(action = 'allow') AS BIGINT) AS allowed_requests,
  CAST(sum(bytes_sent) AS BIGINT) AS total_bytes_sent, CAST(sum(bytes_received) AS BIGINT) AS total_bytes_received,
  count(DISTINCT source_address) AS unique_users, count(DISTINCT url_domain) AS unique_domains,
  avg(response_time_ms) AS avg_response_time FROM urls GROUP BY ALL"""))
def rollup_url_hourly(spark, sf_dir):
    return rollups.url_hourly("ts").exact(fx.urls(spark, sf_dir))


USER_DAILY_SQL = """SELECT CAST(ts AS DATE) AS date, source_user, device_name, count(*) AS total_requests,
  CAST(count_if(action = 'block') AS BIGINT) AS blocked_requests, CAST(sum(bytes_sent + bytes_received) AS BIGINT) AS total_bytes,
  count(DISTINCT url_domain) AS unique_domains, count(DISTINCT url_category) AS unique_categories,
  min(ts) AS first_activity, max(ts) AS last_activity FROM urls WHERE source_user <> '' GROUP BY ALL"""


@query("rollup_user_daily", on_urls(USER_DAILY_SQL))
def rollup_user_daily(spark, sf_dir):
    return rollups.user_daily("ts").exact(fx.urls(spark, sf_dir))


@query("rollup_blocked_hourly", on_urls("""
SELECT date_trunc('hour', ts) AS hour, url_domain, url_category, count(*) AS blocked_count,
  count(DISTINCT source_address) AS unique_users_blocked, count(DISTINCT source_user) AS unique_usernames_blocked
FROM urls WHERE action IN ('block', 'deny', 'drop') GROUP BY ALL"""))
def rollup_blocked_hourly(spark, sf_dir):
    return rollups.blocked_hourly("ts").exact(fx.urls(spark, sf_dir))


HOURLY_MERGED_SQL = """SELECT date_trunc('hour', ts) AS hour, url_category, action, device_name, count(*) AS requests,
  CAST(count_if(action = 'block') AS BIGINT) AS blocked_requests, CAST(count_if(action = 'allow') AS BIGINT) AS allowed_requests,
  CAST(sum(bytes_sent) AS BIGINT) AS total_bytes_sent, CAST(sum(bytes_received) AS BIGINT) AS total_bytes_received,
  count(DISTINCT source_address) AS unique_users, true AS unique_users_close,
  count(DISTINCT url_domain) AS unique_domains, true AS unique_domains_close,
  CAST(sum(response_time_ms) AS DOUBLE) / count(response_time_ms) AS avg_response_time FROM urls GROUP BY ALL"""


def judged_rollup(merged: DataFrame, rollup: rollups.Rollup, rows: DataFrame) -> DataFrame:
    """A merged rollup, its sketched counts judged against one exact pass."""
    return beside_exact(merged, rollup.exact(rows), list(rollup.keys), list(rollup.distinct))


@query("rollup_merge", on_urls(HOURLY_MERGED_SQL))
def rollup_merge(spark, sf_dir):
    """Partial states of two parts, merged."""
    rollup = rollups.url_hourly("ts")
    rows = fx.urls(spark, sf_dir)
    first = rollup.partial(rows.where(F.col("http_method") == "GET"))
    second = rollup.partial(rows.where(F.col("http_method") != "GET"))
    return judged_rollup(rollup.finish(rollup.merge(first.unionByName(second))), rollup, rows)


@query("rollup_merge_sketches", on_urls("SELECT *, true AS unique_domains_close, true AS unique_categories_close FROM (" + USER_DAILY_SQL + ")"))
def rollup_merge_sketches(spark, sf_dir):
    """Daily user activity from partial states, with distinct counts from merged sketches."""
    rollup = rollups.user_daily("ts")
    rows = fx.urls(spark, sf_dir)
    first = rollup.partial(rows.where(F.col("action") == "allow"))
    second = rollup.partial(rows.where(F.col("action") != "allow"))
    return judged_rollup(rollup.finish(rollup.merge(first.unionByName(second))), rollup, rows)


@query("rollup_replacing", on_urls("""
SELECT source_user, device_name, ts, action, session_id FROM (
  SELECT *, row_number() OVER (PARTITION BY source_user, device_name ORDER BY session_id DESC) AS n FROM urls) WHERE n = 1"""))
def rollup_replacing(spark, sf_dir):
    """The newest row per user and device, as a replacing table keeps it."""
    rows = fx.urls(spark, sf_dir).select("source_user", "device_name", "ts", "action", "session_id")
    return rollups.replace_latest(rows, ["source_user", "device_name"], "session_id")


# --- exact distinct counts that merge ---------------------------------------------------------

_DAYS = {
    "first days": TimeWindow(datetime(2024, 1, 1), datetime(2024, 1, 4, 23, 0)),
    "one day": TimeWindow(datetime(2024, 1, 17), datetime(2024, 1, 17, 23, 0)),
    "month": TimeWindow(datetime(2024, 1, 1), datetime(2024, 1, 31, 23, 0)),
}


@query("distinct_from_bitmaps", on_urls(" UNION ALL ".join(
    f"SELECT '{name}' AS days, device_name, count(DISTINCT url) AS distinct_urls FROM urls "
    f"WHERE date_trunc('hour', ts) BETWEEN TIMESTAMP '{w.since}' AND TIMESTAMP '{w.until}' GROUP BY device_name"
    for name, w in _DAYS.items())))
def distinct_from_bitmaps(spark, sf_dir):
    """Distinct URLs by device over several stretches of time, from hourly bitmaps that two loads have stored."""
    path, rows = f"{scratch_dir(spark, 'bitmaps')}/urls", fx.urls(spark, sf_dir)
    keys = {"hour": F.date_trunc("HOUR", "ts").cast("timestamp_ntz"), "device_name": F.col("device_name")}
    for batch, when in enumerate((F.col("http_method") == "GET", F.col("http_method") != "GET")):
        distinct.add(rows.where(when), path, keys, "hour", "url", batch)
    found = None
    for name, window in _DAYS.items():
        sets = distinct.stored(spark, path, "hour timestamp_ntz, device_name string", "hour", window)
        one = distinct.count(sets, ["device_name"], "distinct_urls").select(F.lit(name).alias("days"), "device_name", "distinct_urls")
        found = one if found is None else found.unionByName(one)
    return found
