"""Row acceptance and the statistics of a load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.net import is_ipv4
from flowlens.operators.parse_positional import ERROR, PARSED, SKIPPED


def accepted(source_raw: str, destination_raw: str) -> Column:
    """Both addresses as they stood in the line are IPv4 addresses."""
    return is_ipv4(F.col(source_raw)) & is_ipv4(F.col(destination_raw))


def with_accepted(
    df: DataFrame, source_raw: str = "srcip_raw", destination_raw: str = "dstip_raw"
) -> DataFrame:
    """Add `accepted`, false for rows to quarantine: one pass serves both, as in a write
    partitioned by it."""
    return df.withColumn("accepted", F.coalesce(accepted(source_raw, destination_raw), F.lit(False)))


def split_valid_invalid(
    df: DataFrame, source_raw: str = "srcip_raw", destination_raw: str = "dstip_raw"
) -> tuple[DataFrame, DataFrame]:
    """Rows to store and rows to quarantine, by the same predicate; together they are all rows.

    Two frames read their input twice unless it is stored or persisted, as a batch of a stream is;
    with_accepted does it in one pass.
    """
    good = F.coalesce(accepted(source_raw, destination_raw), F.lit(False))
    return df.where(good), df.where(~good)


def fill_defaults(df: DataFrame, as_of=None) -> DataFrame:
    """No NULLs: numbers 0, text empty, timestamps `as_of` when given."""
    from pyspark.sql import types as T

    from flowlens.functions.times import moment

    filled = {}
    for field in df.schema:
        if isinstance(field.dataType, T.NumericType):
            filled[field.name] = F.coalesce(field.name, F.lit(0).cast(field.dataType))
        elif isinstance(field.dataType, T.StringType):
            filled[field.name] = F.coalesce(field.name, F.lit(""))
        elif as_of is not None and isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            filled[field.name] = F.coalesce(field.name, moment(as_of).cast(field.dataType))
    return df.withColumns(filled)


def stats_columns(outcome: str = "outcome", inserted: Column | None = None) -> list[Column]:
    """Counters of a load, as aggregates: usable in agg() and, on streams, in observe()."""
    kind = F.col(outcome)
    parsed, errors = F.count_if(kind == PARSED), F.count_if(kind == ERROR)
    judged = parsed + errors
    return [
        F.count(F.lit(1)).alias("total_lines"),
        parsed.alias("parsed"),
        F.count_if(kind == SKIPPED).alias("skipped"),
        errors.alias("errors"),
        (F.count_if((kind == PARSED) & inserted) if inserted is not None else parsed).alias("inserted"),
        F.when(judged > 0, parsed / judged * 100).otherwise(0.0).alias("success_pct"),
    ]


def ingest_stats(df: DataFrame, by: list[str] | None = None, inserted: Column | None = None) -> DataFrame:
    """Totals of a load, optionally per device or file; `df` has an `outcome` column."""
    return df.groupBy(*(by or [])).agg(*stats_columns(inserted=inserted))


def parse_rate(parsed: Column, elapsed_seconds: Column) -> Column:
    """Lines per second, 0 before the clock has moved."""
    return F.when(elapsed_seconds > 0, parsed / elapsed_seconds).otherwise(0.0)
