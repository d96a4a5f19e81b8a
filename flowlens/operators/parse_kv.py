"""Key-value log lines (`date=... srcip=... action="..."`) to maps and to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions import net, numbers, text, times
from flowlens.schemas import KINDS, KV_COLUMNS, KV_EXTRA


def kv_pairs(df: DataFrame, line: str = "line") -> DataFrame:
    """Add `_keys` and `_values`, in line order."""
    return df.withColumns(
        {"_keys": text.kv_keys(F.col(line)), "_values": text.kv_values(F.col(line))}
    )


def parse_kv(df: DataFrame, line: str = "line") -> DataFrame:
    """Add `kv`: every pair of the line, unquoted; the last of equal keys counts."""
    pairs = kv_pairs(df, line)
    return pairs.withColumn("kv", text.last_wins_map("_keys", "_values")).drop("_keys", "_values")


def parse_kv_window(df: DataFrame, line: str = "line") -> DataFrame:
    """As `parse_kv`, but only the pairs from the first `date` to the first `rcvdpkt`.

    All pairs stay when either is missing; `rcvdpkt` before `date` leaves none.
    """
    pairs = kv_pairs(df, line)
    first, last = F.array_position("_keys", F.lit("date")), F.array_position("_keys", F.lit("rcvdpkt"))
    both = (first > 0) & (last > 0)
    length = F.greatest(last - first + 1, F.lit(0)).cast("int")

    def cut(array: str) -> Column:
        return F.when(both, F.slice(array, first.cast("int"), length)).otherwise(F.col(array))

    return (
        pairs.withColumns({"_keys": cut("_keys"), "_values": cut("_values")})
        .withColumn("kv", text.last_wins_map("_keys", "_values"))
        .drop("_keys", "_values")
        .withColumn("event_timestamp", times.epoch_micros(F.col("kv")["eventtime"]))
    )


def parse_kv_typed(df: DataFrame, as_of, line: str = "line") -> DataFrame:
    """The fixed typed columns of the key-value table, beside the given columns.

    Adds `srcip_raw` and `dstip_raw` as they stood in the line: rows are judged by those, and an
    IPv6 address survives there.
    """
    keep = [c for c in df.columns if c != line]
    names = {n: n for n in KV_COLUMNS if n not in ("timestamp", "raw_message")} | KV_EXTRA
    keys = names | {"_date": "date", "_time": "time"}
    # One look-up per key, in columns of their own; the typed columns use them several times. The keys are few, so
    # they are looked up where they stand: a map of all pairs costs more than the rest of the parse.
    pairs = kv_pairs(df, line).withColumns({"_keys": F.reverse("_keys"), "_values": F.reverse("_values")})
    found = pairs.select(
        *keep,
        F.col(line).alias("raw_message"),
        *[text.value_of(key, "_keys", "_values").alias(f"_f_{name}") for name, key in keys.items()],
    )

    def column(name: str, kind: str) -> Column:
        value = F.col(f"_f_{name}")
        if kind == "ip":
            return net.clean_ipv4(value)
        if KINDS[kind].limit is not None:
            return numbers.clean_uint(value, KINDS[kind].limit).cast(KINDS[kind].type)
        return F.coalesce(value, F.lit(""))

    time = times.kv_time(F.col("_f__date"), F.col("_f__time"))
    typed = {name: column(name, KV_COLUMNS.get(name, "str")) for name in names}
    typed = {
        "timestamp": F.coalesce(time, times.moment(as_of)),
        "raw_message": F.col("raw_message"),
        **typed,
        "srcip_raw": F.col("_f_srcip"),
        "dstip_raw": F.col("_f_dstip"),
    }
    return found.select(*keep, *[value.alias(name) for name, value in typed.items()])
