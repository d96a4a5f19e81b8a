"""Cleaning of numeric text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE_NUMBER = r"^\s*\+?[0-9]+\s*$"


def clean_uint(text: Column, limit: int = 2**63 - 1) -> Column:
    """Whole number in 0..limit: text, fractions and negatives give 0, larger values the limit.

    Up to 18 characters cannot overflow, so a failed cast means 0 there; only longer text, which
    is rare, has to match the pattern.
    """
    kind = "bigint" if limit < 2**63 else "decimal(20,0)"
    top, zero = F.lit(str(limit)).cast(kind), F.lit(0).cast(kind)
    short = F.least(F.greatest(text.try_cast("bigint").cast(kind), zero), top)
    long = F.when(text.rlike(WHOLE_NUMBER), F.least(F.coalesce(text.try_cast(kind), top), top))
    return F.when(F.length(text) > 18, F.coalesce(long, zero)).otherwise(short)
