"""Positional lines: a syslog header, then comma-separated fields known by their place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions import net, numbers, text, times
from flowlens.functions.url import with_url_parts
from flowlens.schemas import (
    KINDS,
    SLIM_COLUMNS,
    SLIM_POSITIONS,
    TRAFFIC_COLUMNS,
    TRAFFIC_POSITIONS,
    URL_COLUMNS,
    URL_POSITIONS,
)

PARSED, SKIPPED, ERROR = "parsed", "skipped", "error"


def split_header(df: DataFrame, line: str = "line") -> DataFrame:
    """Add `header` (month, day, time, host, rest) and `payload`; NULL payload below five parts."""
    with_header = df.withColumn("header", text.header_parts(F.col(line)))
    return with_header.withColumn("payload", F.get("header", 4))


def traffic_outcome(payload: Column) -> Column:
    """parsed for TRAFFIC lines, skipped for other types, error for lines too short to tell.

    Only the first fields are split off, since Catalyst evaluates a filter on this a second time
    below the split of the whole line.
    """
    kind = F.get(F.split(payload, ",", 5), 3)
    return F.when(kind == "TRAFFIC", PARSED).when(kind.isNotNull(), SKIPPED).otherwise(ERROR)


def url_outcome(payload: Column) -> Column:
    """parsed for THREAT lines of subtype url, in any case; error only without a header."""
    kind, subtype = text.type_fields(payload)
    is_url = (F.upper(kind) == "THREAT") & (F.lower(subtype) == "url")
    return F.when(payload.isNull(), ERROR).when(is_url, PARSED).otherwise(SKIPPED)


def traffic_addresses(payload: Column) -> list[Column]:
    """Source and destination address of a TRAFFIC line as they stand in it, without splitting the rest of the line."""
    first = F.split(payload, ",", 10)
    return [text.not_blank(F.trim(F.get(first, i))) for i, n in TRAFFIC_POSITIONS if n in ("src_ip", "dst_ip")]


def with_traffic_fields(df: DataFrame, line: str = "line") -> DataFrame:
    """Add `header`, `fields` and `outcome`."""
    split = split_header(df, line)
    return split.withColumns(
        {"fields": text.split_plain(F.col("payload")), "outcome": traffic_outcome(F.col("payload"))}
    ).drop("payload")


def with_url_fields(df: DataFrame, line: str = "line") -> DataFrame:
    """Add `header`, `fields` and `outcome`.

    Cleaning all fields in one array expression is faster than fifty copies of that expression in
    the projection that picks them.
    """
    split = split_header(df, line).withColumn("raw", text.raw_fields(F.col("payload")))
    return split.withColumns(
        {"fields": text.cleaned_fields(F.col("raw")), "outcome": url_outcome(F.col("payload"))}
    ).drop("payload", "raw")


def _named(df: DataFrame, positions: list[tuple[int, str]], clean=F.trim) -> DataFrame:
    """One text column `_f_<name>` per named field, beside `header`, the line and the rest.

    Of several positions the last that is not blank counts; NULL if none is. A column of its own
    keeps later uses from taking the field out of the array again.
    """
    found: dict[str, list[Column]] = {}
    for index, name in positions:
        value = text.not_blank(clean(F.get("fields", index)))
        found.setdefault(name, []).insert(0, value)
    keep = [c for c in df.columns if c not in ("fields", "outcome")]
    return df.select(*keep, *[F.coalesce(*v).alias(f"_f_{n}") for n, v in found.items()])


def _field(name: str) -> Column:
    return F.col(f"_f_{name}")


def _typed(df: DataFrame, name: str, kind: str, timestamp: Column, now: Column) -> Column:
    """A field by its kind, with the default of the kind where it is blank or not given."""
    given = f"_f_{name}" in df.columns
    value = _field(name) if given else None
    if kind == "ts":
        # not given: now; given but not readable: the time of the line
        return F.when(value.isNull(), now).otherwise(
            F.coalesce(times.slash_time(value), timestamp)
        ) if given else now
    if kind == "ip":
        return net.clean_ipv4(value) if given else F.lit(net.NO_IP)
    if KINDS[kind].limit is not None:
        number = numbers.clean_uint(value, KINDS[kind].limit) if given else F.lit(0)
        return number.cast(KINDS[kind].type)
    return F.coalesce(value, F.lit("")) if given else F.lit("")


def _protocol(name: Column) -> Column:
    return F.least(net.protocol_number(name), F.lit(255)).cast("smallint")


def _select(df: DataFrame, line: str, columns: dict[str, Column]) -> DataFrame:
    keep = [c for c in df.columns if c not in (line, "header") and not c.startswith("_")]
    return df.select(*keep, *[value.alias(name) for name, value in columns.items()])


def parse_traffic(df: DataFrame, as_of, line: str = "line") -> DataFrame:
    """TRAFFIC lines as the 64 columns of the positional traffic table; other lines drop out.

    Adds `src_ip_raw` and `dst_ip_raw`. The protocol number comes from the protocol name field and
    the device name falls back to the host of the header.
    """
    now = times.moment(as_of)
    rows = with_traffic_fields(df, line).where(F.col("outcome") == PARSED)
    rows = _named(rows, TRAFFIC_POSITIONS)
    rows = rows.withColumn("_full_time", times.slash_time(_field("generated_time")))
    rows = times.with_header_time(rows, "_header_time", "header", "_full_time", now)
    rows = rows.withColumn("_ts", F.coalesce("_header_time", now))
    out = {n: _typed(rows, n, k, F.col("_ts"), now) for n, k in TRAFFIC_COLUMNS.items()}
    out["timestamp"] = F.col("_ts")
    out["raw_message"] = F.col(line)
    out["protocol"] = _protocol(_field("ip_protocol"))
    out["device_name"] = F.coalesce(_field("device_name"), F.get("header", 3))
    out["src_ip_raw"], out["dst_ip_raw"] = _field("src_ip"), _field("dst_ip")
    return _select(rows, line, out)


def parse_slim(df: DataFrame, as_of, line: str = "line") -> DataFrame:
    """TRAFFIC lines as the 19 columns shared with the key-value table."""
    now = times.moment(as_of)
    rows = with_traffic_fields(df, line).where(F.col("outcome") == PARSED)
    rows = _named(rows, [(1, "generated_time"), *SLIM_POSITIONS])
    rows = rows.withColumn("_ts", F.coalesce(times.slash_time(_field("generated_time")), now))
    out = {n: _typed(rows, n, k, F.col("_ts"), now) for n, k in SLIM_COLUMNS.items()}
    out["timestamp"] = F.col("_ts")
    out["raw_message"] = F.col(line)
    out["devname"] = F.get("header", 3)
    out["action"] = F.lower(out["action"])
    out["proto"] = _protocol(_field("proto"))
    out["srcip_raw"], out["dstip_raw"] = _field("srcip"), _field("dstip")
    return _select(rows, line, out)


def traffic_times(df: DataFrame, as_of, line: str = "line") -> DataFrame:
    """line, timestamp and slim_timestamp of TRAFFIC lines, as parse_traffic and parse_slim give them."""
    now = times.moment(as_of)
    rows = with_traffic_fields(df, line).where(F.col("outcome") == PARSED)
    rows = _named(rows, [(1, "generated_time")])
    rows = rows.withColumn("_full_time", times.slash_time(_field("generated_time")))
    rows = times.with_header_time(rows, "_header_time", "header", "_full_time", now)
    return rows.select(
        F.col(line).alias("line"),
        F.coalesce("_header_time", now).alias("timestamp"),
        F.coalesce("_full_time", now).alias("slim_timestamp"),
    )


def _unwrapped(value: Column) -> Column:
    """Without a pair of quotes around the whole value."""
    wrapped = value.startswith('"') & value.endswith('"') & (F.length(value) > 1)
    return F.when(wrapped, value.substr(F.lit(2), F.length(value) - 2)).otherwise(value)


def parse_url(df: DataFrame, as_of, line: str = "line", wide: bool = False) -> DataFrame:
    """Web-access lines (THREAT, subtype url) as the 50 columns of the web-access table.

    The scheme and port of the URL stand in `url_scheme` and `url_port`, apart from the network
    `protocol`. With `wide`, every other named position follows as text.
    """
    now = times.moment(as_of)
    extra = ("high_resolution_timestamp",)
    positions = [(i, n) for i, n in URL_POSITIONS if wide or n in URL_COLUMNS or n in extra]
    rows = with_url_fields(df, line).where(F.col("outcome") == PARSED)
    rows = _named(rows, positions, clean=lambda field: field)
    rows = rows.withColumn("_full_time", times.slash_time(_field("generated_time")))
    rows = times.with_header_time(rows, "_header_time", "header", "_full_time", now)
    rows = rows.withColumn("_received", F.coalesce("_header_time", now))

    out = {n: _typed(rows, n, k, F.col("_received"), now) for n, k in URL_COLUMNS.items()}
    out["receive_time"] = F.col("_received")
    out["timestamp"] = F.coalesce("_full_time", "_received")
    out["generated_time"] = F.coalesce("_full_time", now)
    out["processing_timestamp"] = now
    out["raw_message"] = F.col(line)
    out["device_name"] = F.coalesce(_field("device_name"), F.get("header", 3))
    out["ip_protocol"] = _protocol(_field("ip_protocol"))
    out["protocol"] = F.coalesce(F.lower(_field("ip_protocol")), F.lit(""))
    out["http_method"] = F.upper(out["http_method"])
    for name in ("url", "user_agent", "referer"):
        out[name] = F.coalesce(_unwrapped(_field(name)), F.lit(""))
    for name in ("source_user", "destination_user"):
        out[name] = F.coalesce(text.user_name(_field(name)), F.lit(""))
        out[f"{name}_domain"] = F.coalesce(text.user_domain(_field(name)), F.lit(""))
    out["high_resolution_timestamp"] = times.hires_time(_field("high_resolution_timestamp"))
    if wide:
        for _, name in positions:
            out.setdefault(name, F.coalesce(_field(name), F.lit("")))

    for name in ("url_domain", "url_path", "url_query"):
        out.pop(name)
    typed = with_url_parts(_select(rows, line, out))
    lead = [c for c in df.columns if c != line]
    rest = [c for c in typed.columns if c not in URL_COLUMNS and c not in lead]
    return typed.select(*lead, *URL_COLUMNS, *rest)
