"""Hourly and daily rollups, exact and as mergeable partial states."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators.filters import not_blank

BLOCKING = ("block", "deny", "drop")
SKETCH_LOG_SIZE = 12


def _count_action(action: str) -> Column:
    return F.count_if(F.col("action") == action)


def _hashed(column: str) -> Column:
    """Input of a sketch. Sketches of text leave out the empty text, which is a value here."""
    return F.when(F.col(column).isNotNull(), F.xxhash64(column))


def daily_category_actions(df: DataFrame, ts: str = "timestamp", exact: bool = False) -> DataFrame:
    """Per day, category and action: requests, blocked, distinct sources and domains."""
    distinct = F.countDistinct if exact else F.approx_count_distinct
    return df.groupBy(F.to_date(ts).alias("date"), "url_category", "action").agg(
        F.count(F.lit(1)).alias("requests"),
        _count_action("block").alias("blocked"),
        distinct("source_address").alias("unique_users"),
        distinct("url_domain").alias("unique_domains"),
    )


def uniq_approx(df: DataFrame, by: list[str], columns: list[str], error: float = 0.01) -> DataFrame:
    """Distinct counts by sketches with that relative standard error."""
    return df.groupBy(*by).agg(*[F.approx_count_distinct(c, error).alias(f"uniq_{c}") for c in columns])


@dataclass(frozen=True)
class Rollup:
    """A rollup by its keys, its additive parts and its distinct counts.

    `partial` gives states that `merge` may combine in any order and number; `finish` turns them
    into numbers. Distinct counts travel as HLL sketches and means as sum and count, so late rows
    and repeated merges stay right. `exact` is the one-pass form with exact distinct counts.
    """

    keys: dict[str, Column]
    sums: dict[str, Column]
    distinct: dict[str, str]
    means: dict[str, str] = field(default_factory=dict)
    minima: dict[str, Column] = field(default_factory=dict)
    maxima: dict[str, Column] = field(default_factory=dict)
    where: Column | None = None

    def _rows(self, df: DataFrame) -> DataFrame:
        return df if self.where is None else df.where(self.where)

    def _bounds(self) -> list[Column]:
        low = [F.min(c).alias(n) for n, c in self.minima.items()]
        return low + [F.max(c).alias(n) for n, c in self.maxima.items()]

    def _group(self, df: DataFrame):
        return self._rows(df).groupBy(*[c.alias(n) for n, c in self.keys.items()])

    def exact(self, df: DataFrame) -> DataFrame:
        return self._group(df).agg(
            *[c.alias(n) for n, c in self.sums.items()],
            *[F.countDistinct(c).alias(n) for n, c in self.distinct.items()],
            *[F.avg(c).alias(n) for n, c in self.means.items()],
            *self._bounds(),
        )

    def partial(self, df: DataFrame) -> DataFrame:
        return self._group(df).agg(
            *[c.alias(n) for n, c in self.sums.items()],
            *[
                F.hll_sketch_agg(_hashed(c), F.lit(SKETCH_LOG_SIZE)).alias(f"{n}_sketch")
                for n, c in self.distinct.items()
            ],
            *[F.sum(F.col(c).cast("bigint")).alias(f"{n}_sum") for n, c in self.means.items()],
            *[F.count(c).alias(f"{n}_count") for n, c in self.means.items()],
            *self._bounds(),
        )

    def merge(self, states: DataFrame) -> DataFrame:
        added = [*self.sums, *[f"{n}_{part}" for n in self.means for part in ("sum", "count")]]
        return states.groupBy(*self.keys).agg(
            *[F.sum(n).alias(n) for n in added],
            *[F.hll_union_agg(f"{n}_sketch").alias(f"{n}_sketch") for n in self.distinct],
            *[F.min(n).alias(n) for n in self.minima],
            *[F.max(n).alias(n) for n in self.maxima],
        )

    def finish(self, states: DataFrame) -> DataFrame:
        return states.select(
            *self.keys,
            *self.sums,
            *[F.hll_sketch_estimate(f"{n}_sketch").alias(n) for n in self.distinct],
            *[(F.col(f"{n}_sum") / F.nullif(F.col(f"{n}_count"), F.lit(0))).alias(n) for n in self.means],
            *self.minima,
            *self.maxima,
        )


def url_hourly(ts: str = "timestamp") -> Rollup:
    return Rollup(
        keys={
            "hour": F.date_trunc("HOUR", F.col(ts)),
            "url_category": F.col("url_category"),
            "action": F.col("action"),
            "device_name": F.col("device_name"),
        },
        sums={
            "requests": F.count(F.lit(1)),
            "blocked_requests": _count_action("block"),
            "allowed_requests": _count_action("allow"),
            "total_bytes_sent": F.sum("bytes_sent"),
            "total_bytes_received": F.sum("bytes_received"),
        },
        distinct={"unique_users": "source_address", "unique_domains": "url_domain"},
        means={"avg_response_time": "response_time_ms"},
    )


def user_daily(ts: str = "timestamp") -> Rollup:
    return Rollup(
        keys={
            "date": F.to_date(ts),
            "source_user": F.col("source_user"),
            "device_name": F.col("device_name"),
        },
        sums={
            "total_requests": F.count(F.lit(1)),
            "blocked_requests": _count_action("block"),
            "total_bytes": F.sum(F.col("bytes_sent") + F.col("bytes_received")),
        },
        distinct={"unique_domains": "url_domain", "unique_categories": "url_category"},
        minima={"first_activity": F.col(ts)},
        maxima={"last_activity": F.col(ts)},
        where=not_blank("source_user"),
    )


def blocked_hourly(ts: str = "timestamp") -> Rollup:
    return Rollup(
        keys={
            "hour": F.date_trunc("HOUR", F.col(ts)),
            "url_domain": F.col("url_domain"),
            "url_category": F.col("url_category"),
        },
        sums={"blocked_count": F.count(F.lit(1))},
        distinct={
            "unique_users_blocked": "source_address",
            "unique_usernames_blocked": "source_user",
        },
        where=F.col("action").isin(*BLOCKING),
    )


def replace_latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row with the highest version per key, as a replacing table keeps it after a merge."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_row"))
    return newest.select(*keys, "_row.*")
