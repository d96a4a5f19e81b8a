"""Taking log lines apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as one key=value pair of a line. A key starts at a word boundary and never gives
# characters back, which spares the pattern its backtracking.
KV_PAIR = r'\b(\w++)=("[^"]*"|\S+)'

WHITESPACE = " \t\r\n\x0b\x0c"

# A field of a quoted line after its comma. A quote opens at the start of a field only and closes
# before a comma or the end only; one that follows a comma inside the field never closes.
_QUOTED = r'"(?:[^"]++|(?<=,)"|"(?!,|\z))*+(?:"|\z)'
_FIELD = rf"(?:{_QUOTED}|[^,]*+)"
QUOTED_FIELD = rf",({_FIELD})"
TYPE_FIELDS = rf"^{_FIELD},{_FIELD},{_FIELD},({_FIELD}),({_FIELD})(?:,|\z)"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def not_blank(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def kv_keys(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(KV_PAIR), F.lit(1))


def kv_values(line: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(line, F.lit(KV_PAIR), F.lit(2)), lambda v: F.btrim(v, F.lit('"'))
    )


def last_wins_map(keys: str, values: str) -> Column:
    """Map of two array columns in which the last of several equal keys counts.

    Needs no session setting, unlike letting the map builder drop duplicates.
    """
    last = F.filter(
        F.arrays_zip(keys, values),
        lambda p, i: i == F.size(keys) - F.array_position(F.reverse(keys), p[keys]),
    )
    return F.when(
        F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_arrays(keys, values)
    ).otherwise(F.map_from_entries(last))


def value_of(key: str, keys: str, values: str) -> Column:
    """The value beside the first key of that name in two array columns; NULL without one."""
    return F.get(values, (F.array_position(keys, F.lit(key)) - 1).cast("int"))


def split_plain(payload: Column) -> Column:
    return F.split(payload, ",")


def raw_fields(payload: Column) -> Column:
    """Fields of a comma-separated line in which quoted fields may hold commas, quotes still on."""
    quoted = F.regexp_extract_all(F.concat(F.lit(","), payload), F.lit(QUOTED_FIELD), F.lit(1))
    return F.when(F.contains(payload, F.lit('"')), quoted).otherwise(F.split(payload, ","))


def clean_field(raw: Column) -> Column:
    """A raw field stripped, without the quotes that open and close it. Inside a quoted field, a
    quote after a comma is dropped, too."""
    inner = F.regexp_replace(F.substring(raw, 2, 2**31 - 1), r'(?<=,)"', "")
    closed = raw.endswith('"') & ~raw.endswith(',"') & (F.length(raw) > 1)
    unquoted = F.when(closed, inner.substr(F.lit(1), F.length(inner) - 1)).otherwise(inner)
    return strip(F.when(raw.startswith('"'), unquoted).otherwise(raw))


def cleaned_fields(raw: Column) -> Column:
    """Raw fields, cleaned; an empty last field is dropped."""
    last = F.element_at(raw, -1)
    kept = F.when(last.isin("", '""', '"'), F.slice(raw, 1, F.size(raw) - 1)).otherwise(raw)
    return F.transform(kept, clean_field)


def split_quoted(payload: Column) -> Column:
    """All fields, cleaned; an empty last field is dropped."""
    return cleaned_fields(raw_fields(payload))


def type_fields(payload: Column) -> tuple[Column, Column]:
    """Fields 3 and 4 alone, without splitting the rest of the line; empty below five fields."""
    return tuple(clean_field(F.regexp_extract(payload, TYPE_FIELDS, n)) for n in (1, 2))


def header_parts(line: Column) -> Column:
    """Month, day, time, host and the rest. Runs of blanks separate, as one-digit days are padded."""
    return F.split(F.ltrim(line), r"\s+", 5)


def user_name(user: Column) -> Column:
    """`DOM\\user` or `user@dom` without the domain."""
    backslash, at = F.instr(user, "\\"), F.instr(user, "@")
    return (
        F.when(backslash > 0, user.substr(backslash + 1, F.length(user)))
        .when(at > 0, F.substring_index(user, "@", 1))
        .otherwise(user)
    )


def user_domain(user: Column) -> Column:
    backslash, at = F.instr(user, "\\"), F.instr(user, "@")
    return (
        F.when(backslash > 0, F.substring_index(user, "\\", 1))
        .when(at > 0, user.substr(at + 1, F.length(user)))
        .otherwise("")
    )
