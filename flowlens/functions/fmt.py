"""Byte counts as text. Exact ties round to the even digit, hence `bround`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def _scaled(size: Column, power: int) -> Column:
    return size.cast("double") / F.lit(float(1024**power))


def _fixed(value: Column, digits: int) -> Column:
    """Number with that many decimals, without a call to a formatter per row."""
    return F.bround(value, digits).cast(f"decimal(38,{digits})").cast("string")


def _by_unit(size: Column, top: int, text) -> Column:
    """The first unit in which the number is below 1024, at most units[top]."""
    label = F.when(size < 1024, F.concat(text(0), F.lit(" B")))
    for power in range(1, top):
        label = label.when(
            size < float(1024 ** (power + 1)), F.concat(text(power), F.lit(f" {UNITS[power]}"))
        )
    return label.otherwise(F.concat(text(top), F.lit(f" {UNITS[top]}")))


def bytes_one_decimal(size: Column) -> Column:
    """Monitoring form: always one decimal, `0.0 B` to PB."""
    return _by_unit(size, 5, lambda p: _fixed(_scaled(size, p), 1))


def bytes_page(size: Column) -> Column:
    """Page form: as above, but 0 and NULL are `0 B`."""
    return F.when(F.coalesce(size, F.lit(0)) == 0, "0 B").otherwise(bytes_one_decimal(size))


def bytes_url(size: Column) -> Column:
    """Web-access page form: up to two decimals as a plain number (`1.0 KB`), TB at most."""
    text = _by_unit(size, 4, lambda p: F.bround(_scaled(size, p), 2).cast("string"))
    return F.when(size == 0, "0 B").otherwise(text)


def bytes_humanize(size: Column) -> Column:
    """Filter form: no decimals for B, two for KB to TB; text that is no number stays as it is."""
    number = size.try_cast("double")
    text = _by_unit(number, 4, lambda p: _fixed(_scaled(number, p), 2 if p else 0))
    return F.when(number.isNull(), size.cast("string")).otherwise(text)


def percent_of(size: Column, limit: int) -> Column:
    return size.cast("double") / F.lit(float(limit)) * 100
