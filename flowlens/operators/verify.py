"""Verification of a load by content: which rows of which file are gone, foreign or repeated.

Checksums do not depend on the order of rows: the number of rows and the sum of their 64-bit hashes. Files are compared
first, then the hash buckets of files that differ, and only the rows of buckets that differ are compared themselves. A
difference goes unseen if number and sum agree by chance, once in 2**64 or so. Nulls are values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024


def checksums(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """`by`, rows, checksum; summed up on each task before the shuffle."""
    total = F.sum(F.xxhash64(*columns).cast("decimal(20,0)").cast("decimal(38,0)"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), total.alias("checksum"))


def unequal(expected: DataFrame, stored: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """The groups whose number of rows or checksum differ, with both numbers."""
    a = checksums(expected, by, columns).withColumnsRenamed({"rows": "parsed_rows", "checksum": "parsed_checksum"})
    b = checksums(stored, by, columns).withColumnsRenamed({"rows": "stored_rows", "checksum": "stored_checksum"})
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by])
    both = a.alias("a").join(b.alias("b"), same, "full_outer")
    differ = ~(F.col("parsed_rows").eqNullSafe(F.col("stored_rows")) & F.col("parsed_checksum").eqNullSafe(F.col("stored_checksum")))
    return both.where(differ).select(
        *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in by],
        F.coalesce("parsed_rows", F.lit(0)).alias("parsed_rows"),
        F.coalesce("stored_rows", F.lit(0)).alias("stored_rows"),
    )


def _of_files(rows: DataFrame, files: DataFrame, file_column: str, within: Column | None = None) -> DataFrame:
    """The rows of these files, of which there is one entry each; so the entries go to the rows, and no row is shuffled."""
    same = F.col(f"r.{file_column}").eqNullSafe(F.col(f"g.{file_column}"))
    same = same if within is None else same & within
    return rows.alias("r").join(F.broadcast(files.alias("g")), same, "left_semi").select("r.*")


def differences(expected: DataFrame, stored: DataFrame, file_column: str, columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """file, columns, parsed_copies, stored_copies, finding of each distinct row that is not stored as often as parsed.

    finding: lost, foreign (not parsed), copies lost, or repeated.
    """
    names = [file_column, *columns]
    sides = [df.select(*names, F.pmod(F.xxhash64(*columns), F.lit(buckets)).alias("bucket")) for df in (expected, stored)]
    files = unequal(*sides, [file_column], columns)
    sides = [_of_files(df, files.select(file_column), file_column) for df in sides]
    groups = unequal(*sides, [file_column, "bucket"], columns)
    listed = groups.groupBy(file_column).agg(F.collect_list(F.col("bucket").cast("int")).alias("buckets"))
    inside = F.array_contains(F.col("g.buckets"), F.col("r.bucket").cast("int"))
    parsed, kept = (_of_files(df, listed, file_column, inside) for df in sides)
    each = parsed.withColumns({"p": F.lit(1), "s": F.lit(0)}).unionByName(kept.withColumns({"p": F.lit(0), "s": F.lit(1)}))
    counts = each.groupBy(*names).agg(F.sum("p").alias("parsed_copies"), F.sum("s").alias("stored_copies"))
    p, s = F.col("parsed_copies"), F.col("stored_copies")
    finding = F.when(s == 0, "lost").when(p == 0, "foreign").when(s < p, "copies lost").otherwise("repeated")
    return counts.where(p != s).withColumn("finding", finding)
