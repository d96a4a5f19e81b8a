"""Log tables as partitioned Parquet: writing, reading, retention, and exports."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.times import moment, month
from flowlens import session
from flowlens.session import remove, scratch_dir, shuffles_dropped

RETENTION_DAYS = 90
# Rows that one task sorts when a table is clustered.
SORTED_ROWS = 500_000


def scan(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A whole table; a given schema saves reading footers to find one."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def scan_evolved(
    spark: SparkSession, paths: list[str], schema: T.StructType, defaults: dict[str, object]
) -> DataFrame:
    """Files written before and after columns were added, as one frame.

    The wanted schema is given, so no footer merging is needed; columns an old file lacks come out
    NULL and take their default.
    """
    df = spark.read.schema(schema).parquet(*paths)
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def by_month(df: DataFrame) -> DataFrame:
    """Rows shuffled by `ym`, so that a month is written as few files of a good size.

    Adaptive execution sizes the tasks: small months share one, and a month that holds most of the
    rows is split over many. It splits by the tasks that wrote the rows, so a month that one task
    has written stays one file.
    """
    return df.hint("rebalance", F.col("ym"))


def append(df: DataFrame, path: str, ts: str = "timestamp") -> None:
    """Append rows below their month."""
    _partitioned(by_month(df.withColumn("ym", month(F.col(ts)))), path, "append")


def _partitioned(df: DataFrame, path: str, mode: str, **options: str) -> None:
    df.write.mode(mode).options(**options).partitionBy("ym").parquet(path)


def write_clustered(
    df: DataFrame | list[DataFrame],
    path: str,
    order: list[str],
    ts: str = "timestamp",
    partitions: int | None = None,
    bloom: list[str] = (),
) -> None:
    """Rewrite a table by month, sorted by `order`, so that row groups hold narrow ranges.

    Range partitioning by month and order gives each task one stretch of time. A month or even a
    second with very many rows spreads over tasks by the later order columns and, for rows equal
    in all of them, by a hash of the whole row. The rows are written once before, since finding the
    ranges reads them, too, and their number gives that of the tasks: none sorts many more than
    SORTED_ROWS, however large the table.

    Shuffled rows are several times as large as stored ones. So a table of many rows may be given as several frames, which are
    staged one after the other, and one that is ordered by time is sorted in rounds of about ROUND_ROWS rows; the shuffle files
    of each go before the next.
    """
    frames = [df] if isinstance(df, DataFrame) else df
    spark = frames[0].sparkSession
    staged = scratch_dir(spark, "staged")
    with shuffles_dropped(spark):
        # Folders by year let a round pass over the years that it does not need.
        extra = {"ym": month(F.col(ts))} | ({"_year": F.year(ts)} if len(frames) > 1 else {})
        for number, frame in enumerate(frames):
            writer = frame.withColumns(extra).write
            (writer.partitionBy("_year") if len(frames) > 1 else writer).parquet(f"{staged}/rows/frame={number}")
        rows = spark.read.schema(frames[0].withColumns(extra).schema).option("basePath", f"{staged}/rows").parquet(f"{staged}/rows")
        rows = rows.select(*frames[0].columns, *extra)
        count, columns = rows.count(), [*frames[0].columns, "ym"]
        rounds = _rounds(rows, ts, count) if order[0] == ts else [F.lit(True)]
        each = -(-count // len(rounds))
        if partitions is None:
            wanted = -(-each // SORTED_ROWS)
            tasks = wanted if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) else None
        else:
            tasks = -(-partitions // len(rounds))
        # The hash is found where it is compared, as no other column would take so much room in a shuffle.
        keys = ["ym", *order, F.xxhash64(*columns)]
        options = {f"parquet.bloom.filter.enabled#{c}": "true" for c in bloom}
        for number, stretch in enumerate(rounds):
            some = rows.where(stretch).select(*columns)
            ranged = some.repartitionByRange(*keys) if tasks is None else some.repartitionByRange(tasks, *keys)
            _partitioned(ranged.sortWithinPartitions(*keys), path, "append" if number else "overwrite", **options)
    remove(spark, staged)


def _rounds(rows: DataFrame, ts: str, count: int) -> list[Column]:
    """Predicates on stretches of time with about ROUND_ROWS of the rows each; the first one has the rows without a time. Rows of
    one time are not parted."""
    wanted = -(-count // session.ROUND_ROWS)
    if wanted < 2:
        return [F.lit(True)]
    cuts = F.percentile_approx(ts, [i / wanted for i in range(1, wanted)])
    named = F.transform(cuts, lambda at: F.struct(at.cast("string").alias("at"), F.year(at).alias("year")))
    found = list(dict.fromkeys((c["at"], c["year"]) for c in rows.agg(named.alias("cuts")).first()["cuts"] or []))
    kind = rows.schema[ts].dataType

    def since(cut: tuple[str, int]) -> Column:
        return F.col(ts) >= F.lit(cut[0]).cast(kind)

    stretches = []
    for low, high in zip([None, *found], [*found, None], strict=True):
        inside = F.lit(True) if low is None else since(low)
        if high is not None:
            inside &= ~since(high) if low is not None else ~since(high) | F.col(ts).isNull()
        if "_year" in rows.columns:
            known = F.lit(True) if low is None else F.col("_year") >= low[1]
            if high is not None:
                known &= F.col("_year") <= high[1] if low is not None else (F.col("_year") <= high[1]) | F.col("_year").isNull()
            inside &= known
        stretches.append(inside)
    return stretches


def retained(df: DataFrame, as_of: datetime, ts: str = "timestamp", days: int = RETENTION_DAYS) -> DataFrame:
    """Rows not older than the retention time."""
    return df.where(F.col(ts) >= moment(as_of) - F.expr(f"INTERVAL {days} DAYS"))


def retention_plan(df: DataFrame, as_of: datetime, days: int = RETENTION_DAYS) -> DataFrame:
    """What to do with each month of a table: drop it whole, rewrite the one the limit falls in,
    or keep it. Only the partition column is read."""
    limit = as_of - timedelta(days=days)
    edge = limit.year * 100 + limit.month
    step = F.when(F.col("ym") < edge, "drop").when(F.col("ym") == edge, "rewrite").otherwise("keep")
    return df.select("ym").distinct().withColumn("step", step)


def apply_retention(
    spark: SparkSession, path: str, target: str, as_of: datetime, ts: str = "timestamp",
    days: int = RETENTION_DAYS,
) -> None:
    """Write the retained rows to a new place. Months before the limit are not read at all."""
    limit = as_of - timedelta(days=days)
    table = spark.read.parquet(path).where(F.col("ym") >= limit.year * 100 + limit.month)
    _partitioned(by_month(retained(table, as_of, ts, days)), target, "overwrite")


def scratch_table(spark: SparkSession, name: str) -> str:
    """A new table name in a database of its own below the shared folder."""
    path = scratch_dir(spark, f"{name}-db")
    database = "scratch_" + path.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {database} LOCATION '{path}'")
    return f"{database}.{name}"


def create_table(df: DataFrame, name: str, ts: str = "timestamp") -> None:
    """A catalogue table by month."""
    by_month(df.withColumn("ym", month(F.col(ts)))).write.partitionBy("ym").saveAsTable(name)


def table_months(spark: SparkSession, name: str) -> list[int]:
    """The months of a catalogue table, from the catalogue alone."""
    return sorted(int(row["partition"].split("=")[1]) for row in spark.sql(f"SHOW PARTITIONS {name}").collect())


def expire(
    spark: SparkSession, name: str, as_of: datetime, ts: str = "timestamp", days: int = RETENTION_DAYS
) -> dict[int, str]:
    """Remove old rows of a catalogue table by month where they lie; returns what was done to which month.

    Months before the limit are dropped as partitions, without being read. The month that the limit falls in is
    rewritten by an overwrite of that partition alone, if it has old rows; it is dropped if it has no others. Other
    months are not touched. The work may be repeated: after a failure the next run does what is left.
    """
    limit = as_of - timedelta(days=days)
    edge = limit.year * 100 + limit.month
    months = table_months(spark, name)
    done = {ym: "dropped" for ym in months if ym < edge}
    if edge in months:
        rows = spark.table(name).where(F.col("ym") == edge)
        new = F.col(ts) >= moment(limit)
        if rows.where(new).isEmpty():
            done[edge] = "dropped"
        elif not rows.where(~new | F.col(ts).isNull()).isEmpty():
            done[edge] = "rewritten"
            _overwrite_months(spark, rows.where(new), name)
    gone = ", ".join(f"PARTITION (ym = {ym})" for ym, step in done.items() if step == "dropped")
    if gone:
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS {gone}")
    return done


def _overwrite_months(spark: SparkSession, rows: DataFrame, name: str) -> None:
    """Replace the months that rows have, by their own rows too, and no other month."""
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        by_month(rows).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(key, before)


def _as_text(df: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]


def export_csv(df: DataFrame, path: str) -> None:
    """Header, every value quoted, quotes doubled."""
    df.select(*_as_text(df)).write.mode("overwrite").options(
        header="true", quoteAll="true", escape='"'
    ).csv(path)


def export_json(df: DataFrame, path: str, details: str | None = None) -> None:
    """JSON lines with lower-cased names. Keys of the `details` map join in where the row has no
    such value yet."""
    rows = df.select(*[F.col(c).alias(c.lower()) for c in df.columns if c != details],
                     *([F.col(details).alias("_details")] if details else []))
    if not details:
        rows.write.mode("overwrite").json(path)
        return
    plain = [c for c in rows.columns if c != "_details"]
    base = F.create_map(
        *[x for c in plain for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    )
    extra = F.transform_keys("_details", lambda k, _: F.lower(F.trim(F.replace(k, F.lit(":"), F.lit("")))))
    set_in_row = F.map_filter(base, lambda _, v: v != "")
    missing = F.map_filter(extra, lambda k, _: ~F.map_contains_key(set_in_row, k))
    blank = F.map_filter(base, lambda k, v: (v == "") & ~F.map_contains_key(missing, k))
    rows.select(F.to_json(F.map_concat(set_in_row, missing, blank)).alias("value")).write.mode(
        "overwrite"
    ).text(path)
