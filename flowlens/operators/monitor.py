"""Health of the ingest: file sizes, lag, rotation, load checks, cleanup, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.fmt import bytes_one_decimal, percent_of
from flowlens.functions.times import moment

MIB, GIB = 1024**2, 1024**3

# Limits of the alerts and ages of the cleanup.
SIZE_WARNING, SIZE_CRITICAL = int(1.5 * GIB), int(1.8 * GIB)
LAG_WARNING, LAG_CRITICAL = 100 * MIB, 500 * MIB
SIZE_LIMIT = 2 * GIB
ARCHIVE_DAYS, PURGE_DAYS = 7, 30
ACTIVE_SECONDS = 300


def _level(size: Column, warning: float, critical: float) -> Column:
    return F.when(size >= critical, "critical").when(size >= warning, "warning").otherwise("ok")


def file_alerts(files: DataFrame) -> DataFrame:
    """Alert level of each tracked file by its size; a missing file is only `info`.

    `files` has path, file_exists and size.
    """
    size = F.when(F.col("file_exists"), F.col("size")).otherwise(0)
    return files.select(
        "path",
        "file_exists",
        size.alias("size"),
        F.when(F.col("file_exists"), bytes_one_decimal(size)).otherwise("0 B").alias("size_label"),
        percent_of(size, SIZE_LIMIT).alias("percent_of_limit"),
        F.when(~F.col("file_exists"), "info")
        .otherwise(_level(size, SIZE_WARNING, SIZE_CRITICAL))
        .alias("alert_level"),
    )


def ingest_lag(files: DataFrame, progress: DataFrame) -> DataFrame:
    """Bytes of each file not yet processed; a file without progress is `info` with no lag.

    `files` has path, file_exists and size; `progress` has path, position and total_lines.
    """
    joined = files.join(progress.select("path", "position", "total_lines"), "path", "left")
    known = F.col("position").isNotNull()
    size = F.when(F.col("file_exists"), F.col("size")).otherwise(0)
    lag = F.when(known, F.greatest(F.lit(0), size - F.col("position"))).otherwise(0)
    return joined.select(
        "path",
        lag.alias("lag_bytes"),
        F.when(known, bytes_one_decimal(lag)).otherwise("0 B").alias("lag_label"),
        F.when(known, _level(lag, LAG_WARNING, LAG_CRITICAL)).otherwise("info").alias("alert_level"),
        F.coalesce("total_lines", F.lit(0)).alias("total_lines"),
    )


def rotation_stats(records: DataFrame) -> DataFrame:
    """Totals over rotated files. `records` has rotated_size, safe_to_delete, processing_start_time."""
    verified = F.count_if("safe_to_delete")
    total = F.coalesce(F.sum("rotated_size"), F.lit(0))
    last = F.max("processing_start_time")
    return records.agg(
        F.count(F.lit(1)).alias("total_rotated_files"),
        verified.alias("verified_files"),
        (F.count(F.lit(1)) - verified).alias("pending_verification"),
        total.alias("total_rotated_size"),
        bytes_one_decimal(total).alias("total_rotated_size_label"),
        F.coalesce(F.date_format(last, "yyyy-MM-dd HH:mm:ss"), F.lit("Never")).alias("last_rotation"),
    )


def overall_severity(*levels: DataFrame) -> DataFrame:
    """The worst alert level of all frames, `ok` when there is nothing worse."""
    rank = F.when(F.col("alert_level") == "critical", 2).when(
        F.col("alert_level") == "warning", 1
    ).otherwise(0)
    ranks = [df.agg(F.coalesce(F.max(rank), F.lit(0)).alias("rank")) for df in levels]
    combined = ranks[0]
    for other in ranks[1:]:
        combined = combined.unionByName(other)
    worst = F.max("rank")
    return combined.agg(
        F.when(worst == 2, "critical").when(worst == 1, "warning").otherwise("ok").alias("overall_status")
    )


# Texts of the alerts.
ALERT_TEXTS = {
    "size_critical": " has reached critical size: ",
    "size_warning": " approaching size limit: ",
    "size_details_before": "File is at ",
    "size_details_after": "% of 2GB limit",
    "lag_critical": " has critical processing lag: ",
    "lag_warning": " has processing lag: ",
    "lag_details_before": "Processing is behind by ",
}


def alert_rows(file_levels: DataFrame, lag_levels: DataFrame) -> DataFrame:
    """One row per warning or critical file size or lag, with its message."""
    name = F.substring_index("path", "/", -1)
    raised = F.col("alert_level").isin("critical", "warning")
    critical = F.col("alert_level") == "critical"
    percent = F.bround("percent_of_limit", 1).cast("decimal(20,1)").cast("string")
    sizes = file_levels.where(raised).select(
        "path",
        F.lit("size").alias("about"),
        F.col("alert_level").alias("type"),
        F.concat(
            name,
            F.when(critical, ALERT_TEXTS["size_critical"]).otherwise(ALERT_TEXTS["size_warning"]),
            F.col("size_label"),
        ).alias("message"),
        F.concat(F.lit(ALERT_TEXTS["size_details_before"]), percent, F.lit(ALERT_TEXTS["size_details_after"])).alias("details"),
    )
    lags = lag_levels.where(raised).select(
        "path",
        F.lit("lag").alias("about"),
        F.col("alert_level").alias("type"),
        F.concat(
            name,
            F.when(critical, ALERT_TEXTS["lag_critical"]).otherwise(ALERT_TEXTS["lag_warning"]),
            F.col("lag_label"),
        ).alias("message"),
        F.concat(F.lit(ALERT_TEXTS["lag_details_before"]), F.col("lag_label")).alias("details"),
    )
    return sizes.unionByName(lags)


def load_verify(expected: DataFrame, stored: DataFrame, file_column: str = "file") -> DataFrame:
    """Whether every parsed row of a file is in the target, hence the file may go.

    `expected` has one row per file with `parsed_rows`; `stored` are the rows of the target. They
    are counted per file before the join, so a file with very many rows is one row there.
    """
    counts = stored.groupBy(file_column).agg(F.count(F.lit(1)).alias("stored_rows"))
    joined = expected.join(counts, file_column, "left")
    found = F.coalesce("stored_rows", F.lit(0))
    return joined.select(
        file_column,
        "parsed_rows",
        found.alias("stored_rows"),
        ((found == F.col("parsed_rows")) & (found > 0)).alias("safe_to_delete"),
    )


def cleanup_plan(records: DataFrame, as_of) -> DataFrame:
    """What may happen to each rotated file: keep, archive (7 days verified) or purge (30 days)."""
    now = moment(as_of)

    def older(days: int) -> Column:
        return F.col("verified_at").cast("timestamp") < now - F.expr(f"INTERVAL {days} DAYS")

    verified = F.col("safe_to_delete") & F.col("verified_at").isNotNull()
    step = (
        F.when(verified & older(PURGE_DAYS), "purge")
        .when(verified & older(ARCHIVE_DAYS), "archive")
        .otherwise("keep")
    )
    return records.withColumn("cleanup", step)


def source_freshness(
    df: DataFrame, as_of, ts: str = "timestamp", device: str = "device_name",
    active_seconds: int = ACTIVE_SECONDS,
) -> DataFrame:
    """Last log of each device up to `as_of`, and whether it is recent enough to call it active."""
    now = moment(as_of)
    last = df.where(F.col(ts) <= now).groupBy(device).agg(F.max(ts).alias("last_seen"))
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col("last_seen").cast("timestamp"))
    return last.withColumns({"age_seconds": age, "is_active": age < active_seconds})


def source_activity(
    df: DataFrame, as_of, ts: str = "timestamp", device: str = "device_name"
) -> DataFrame:
    """Logs of the day of `as_of`, of the hour before it, and in total, per device."""
    now, time = moment(as_of), F.col(ts)
    past = time <= now
    return df.groupBy(device).agg(
        F.count_if(past & (time >= F.date_trunc("DAY", now))).alias("logs_today"),
        F.count_if(past & (time >= now - F.expr("INTERVAL 1 HOUR"))).alias("logs_last_hour"),
        F.count(F.lit(1)).alias("total_logs"),
    )


def source_status_counts(freshness: DataFrame, approved: list[str], device: str = "device_name") -> DataFrame:
    """Devices in total, active, inactive, and pending, i.e. sending without being approved."""
    known = F.col(device).isin(approved)
    return freshness.agg(
        F.count(F.lit(1)).alias("total_sources"),
        F.count_if(known & F.col("is_active")).alias("active_sources"),
        F.count_if(known & ~F.col("is_active")).alias("inactive_sources"),
        F.count_if(~known).alias("pending_sources"),
    )


def status_summary(files: DataFrame, updated: str = "modified") -> DataFrame:
    """Tracked files, their size, and the last change of the registry."""
    size = F.coalesce(F.sum(F.when(F.col("file_exists"), F.col("size"))), F.lit(0))
    return files.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if("file_exists").alias("present_files"),
        size.alias("total_size"),
        bytes_one_decimal(size).alias("total_size_label"),
        F.max(updated).alias("registry_last_updated"),
    )
