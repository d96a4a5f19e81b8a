"""Rows as the pages show them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.fmt import bytes_page, bytes_url
from flowlens.functions.net import protocol_label


def _text(column: str, missing: str) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(missing))


def _time(ts: str) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("N/A"))


def log_display_rows(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Unified rows with labels; only NULL becomes `N/A`, blanks stay blank."""
    duration = F.coalesce("elapsed_time", F.lit(0))
    shown = {
        "ts_display": _time(ts),
        "action": F.col("action"),
        "srcip": F.col("src_ip"),
        "srcport": F.col("src_port"),
        "dstip": F.col("dst_ip"),
        "dstport": F.col("dst_port"),
        "proto_label": protocol_label(F.col("protocol")),
        "rcvdbyte_label": bytes_page(F.col("bytes_received")),
        "sentbyte_label": bytes_page(F.col("bytes_sent")),
        "duration_ms": duration,
        "duration_label": F.concat(duration.cast("string"), F.lit("ms")),
        "sentpkt": F.col("packets_sent"),
        "rcvdpkt": F.col("packets_received"),
        "srcintf": F.col("src_interface"),
        "dstintf": F.col("dst_interface"),
        "policyname": F.col("rule_name"),
        "raw_message": F.col("raw_message"),
        "log_source": F.coalesce("log_source", F.lit("unknown")),
    }
    for out, column in (
        ("username", "src_user"),
        ("srccountry", "src_country"),
        ("dstcountry", "dst_country"),
        ("device_name", "device_name"),
        ("application", "application"),
    ):
        shown[out] = F.coalesce(column, F.lit("N/A"))
    shown["threat_id"] = F.coalesce("threat_id", F.lit(""))
    shown["severity"] = F.coalesce("severity", F.lit(""))
    return df.select(*[c.alias(n) for n, c in shown.items()])


def url_display_rows(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Web-access rows with `N/A` for blanks and three byte labels."""
    sent, received = (F.coalesce(c, F.lit(0)) for c in ("bytes_sent", "bytes_received"))
    names = (
        "url", "url_domain", "action", "source_address", "destination_address", "device_name",
        "http_method", "user_agent", "source_user", "rule_name", "application",
    )
    return df.select(
        _time(ts).alias("timestamp"),
        *[_text(n, "N/A").alias(n) for n in names],
        _text("url_category", "uncategorized").alias("url_category"),
        F.coalesce("response_code", F.lit(0)).alias("response_code"),
        sent.alias("bytes_sent"),
        received.alias("bytes_received"),
        (sent + received).alias("total_bytes"),
        bytes_url(sent).alias("bytes_sent_label"),
        bytes_url(received).alias("bytes_received_label"),
        bytes_url(sent + received).alias("total_bytes_label"),
        F.coalesce("raw_message", F.lit("")).alias("raw_message"),
    )


def duration_bar(df: DataFrame, column: str = "elapsed_time") -> DataFrame:
    """Add `bar_width`: duration relative to the longest shown (100 at least), 10 to 80 percent.

    The longest duration is a scalar subquery, so no window pulls all rows into one task.
    """
    longest = F.greatest(df.agg(F.max(column)).scalar(), F.lit(100))
    return df.withColumn("bar_width", F.greatest(F.lit(10.0), F.col(column) / longest * 80))
