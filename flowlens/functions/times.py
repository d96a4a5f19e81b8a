"""Timestamps of log lines. `as_of` always stands for "now", so that runs can be repeated."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF_YEAR_DAYS = 183


def moment(value: datetime | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp")


def parse_time(text: Column, pattern: str) -> Column:
    """Timestamp, or NULL when the text does not fit the pattern."""
    return F.try_to_timestamp(text, F.lit(pattern))


def kv_time(date: Column, time: Column) -> Column:
    return parse_time(F.concat_ws(" ", date, time), "yyyy-M-d H:m:s")


def slash_time(text: Column) -> Column:
    return parse_time(F.trim(text), "yyyy/M/d H:m:s")


def with_header_time(df: DataFrame, name: str, parts: str, near: str, as_of: Column) -> DataFrame:
    """Add the time of a syslog header, which has no year; NULL when it is no time.

    With a full timestamp from the line (`near`), the year is the one that comes closest to it;
    without, the latest year that does not lie more than a day after `as_of`.
    """
    same, full = F.col("_same_year"), F.col(near)
    reference = F.coalesce(full, as_of)

    def in_year(shift: int) -> Column:
        text = F.concat_ws(
            " ", F.year(reference) + shift, F.get(parts, 0), F.get(parts, 1), F.get(parts, 2)
        )
        return parse_time(text, "yyyy MMM d H:m:s")

    days = F.datediff(same, reference)
    late = F.when(full.isNull(), same > as_of + F.expr("INTERVAL 1 DAY")).otherwise(
        days > HALF_YEAR_DAYS
    )
    early = full.isNotNull() & (days < -HALF_YEAR_DAYS)
    chosen = F.when(late, in_year(-1)).when(early, in_year(1)).otherwise(same)
    return df.withColumn("_same_year", in_year(0)).withColumn(name, chosen).drop("_same_year")


def hires_time(text: Column) -> Column:
    """ISO time with up to microseconds; a `+03:00` or `Z` is dropped without shifting."""
    plain = F.replace(F.replace(F.trim(text), F.lit("+03:00"), F.lit("")), F.lit("Z"), F.lit(""))
    return F.when(
        F.contains(plain, F.lit("T")), F.try_to_timestamp(plain)
    )


def epoch_micros(text: Column) -> Column:
    """Microseconds since 1970; NULL when the text is no whole number."""
    return F.timestamp_micros(text.try_cast("bigint"))


def with_time_columns(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Derived date, hour, clock text and month of the event time."""
    return df.withColumns(
        {
            "log_date": F.to_date(ts),
            "log_hour": F.date_trunc("HOUR", F.col(ts)),
            "log_time": F.date_format(ts, "HH:mm:ss"),
            "ym": month(F.col(ts)),
        }
    )


def month(ts: Column) -> Column:
    """Year and month as the number yyyyMM, the partition key of the log tables."""
    return F.year(ts) * 100 + F.month(ts)
