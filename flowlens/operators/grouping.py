"""Traffic grouped by flow and by /24 network of the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.fmt import bytes_page
from flowlens.functions.net import protocol_label, subnet24

FLOW_KEYS = ["src_ip", "dst_ip", "dst_port", "action"]
SUBNET_KEYS = ["src_subnet", "dst_ip", "dst_port", "action"]


def flow_groups(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Events, bytes, one protocol (the least, for repeatable runs) and last time per flow."""
    return df.groupBy(*FLOW_KEYS).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sum("bytes_sent").alias("total_sent"),
        F.sum("bytes_received").alias("total_received"),
        F.min("protocol").alias("protocol"),
        F.max(ts).alias("last_seen"),
    )


def count_flow_groups(df: DataFrame) -> DataFrame:
    return df.select(*FLOW_KEYS).distinct().agg(F.count(F.lit(1)).alias("flow_groups"))


def _with_subnet(flows: DataFrame) -> DataFrame:
    return flows.withColumn("src_subnet", subnet24(F.col("src_ip")))


def _protocols() -> Column:
    names = F.array_sort(F.collect_set(protocol_label(F.col("protocol"))))
    return F.when(F.size(names) == 0, "N/A").otherwise(F.array_join(names, ", "))


def _totals() -> list[Column]:
    return [
        F.sum("event_count").alias("event_count"),
        F.sum("total_sent").alias("total_sent"),
        F.sum("total_received").alias("total_received"),
        F.max("last_seen").alias("last_seen"),
        _protocols().alias("protocols"),
    ]


def subnet_rollup(flows: DataFrame) -> DataFrame:
    """Flow groups summed per source network. Protocol sets hold at most 256 labels."""
    return _with_subnet(flows).groupBy(*SUBNET_KEYS).agg(*_totals())


def subnet_details(flows: DataFrame) -> DataFrame:
    """The rollup with its flows nested, most events first, and a `group_id`.

    A group holds at most 256 flows, one per address of the /24, as an address that is not plain
    IPv4 is a network of its own; so the nested list is bounded however large the traffic is.
    """
    detail = F.struct(
        (-F.col("event_count")).alias("order"),
        "src_ip",
        "event_count",
        "total_sent",
        "total_received",
        "protocol",
        "last_seen",
    )
    grouped = _with_subnet(flows).groupBy(*SUBNET_KEYS).agg(
        *_totals(), F.array_sort(F.collect_list(detail)).alias("details")
    )
    return grouped.withColumns(
        {
            "details": F.transform("details", lambda d: d.dropFields("order")),
            "group_id": group_slug(),
            "total_sent_label": bytes_page(F.col("total_sent")),
            "total_received_label": bytes_page(F.col("total_received")),
        }
    )


def group_slug() -> Column:
    """Id of a subnet group for use in a page: dots and slashes of the addresses become `_`."""
    return F.lower(
        F.translate(
            F.concat_ws(
                "-",
                F.lit("subnetgroup"),
                F.translate("src_subnet", "/.", "__"),
                F.translate("dst_ip", ".", "_"),
                F.col("dst_port").cast("string"),
                F.col("action"),
            ),
            " ",
            "_",
        )
    )


def subnet_order(sort_by: str = "last_seen", order: str = "desc") -> list[Column]:
    """Sort columns of the grouped page, total: ties go by newest and then by the group keys."""
    columns = {"dstip": "dst_ip", "count": "event_count", "last_seen": "last_seen"}
    if sort_by not in columns:
        sort_by, order = "last_seen", "desc"
    direction = F.desc if order == "desc" else F.asc
    return [direction(columns[sort_by]), F.desc("last_seen"), *[F.asc(k) for k in SUBNET_KEYS]]
