"""Vectors packed in blocks, and a stated query set that meets all blocks.

A block holds neighbouring rows of one input partition as numpy matrices in one value. Query blocks are
copied to each of `salts` groups of blocks and meet them by an equi-join on the group, so every pair of blocks is one row
of work, nothing is collected, and no row is paired singly. All queries against all rows grow with the square of
the input when queries are a share of the rows; blocks keep that to numpy operations.

Vectors that are null, or hold null or non-finite components, take no part. Shorter vectors are filled with
zeros up to the longest of both blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import land, partition_id, ship

BLOCK_ROWS, QUERY_ROWS = 4096, 1024


def usable(embedding: Column) -> Column:
    """No component null, NaN or infinite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return embedding.isNotNull() & ~bad


def matrix(column: pa.ListArray) -> np.ndarray:
    """Rows as doubles, short ones filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), int(lengths.max()) if len(lengths) else 0))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def widened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))


def blocks(vectors: DataFrame, rows_per_block: int, name: str) -> DataFrame:
    """block long, n int, width int, ids binary (int64), data binary (float64); of vec_id, embedding."""
    ship(vectors.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = partition_id() << 32, []
        have = 0

        def out(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(rows).combine_chunks()
            data = matrix(table.column("embedding"))
            return pa.record_batch(
                {
                    "block": pa.array([number], pa.int64()),
                    "n": pa.array([len(data)], pa.int32()),
                    "width": pa.array([data.shape[1]], pa.int32()),
                    "ids": pa.array([table.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()),
                    "data": pa.array([data.astype("<f8").tobytes()], pa.binary()),
                }
            )

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(rows_per_block - have, batch.num_rows - at)
                held.append(batch.slice(at, take))
                at, have = at + take, have + take
                if have == rows_per_block:
                    yield out(held)
                    number, held, have = number + 1, [], 0
        if held:
            yield out(held)

    return land(vectors.mapInArrow(pack, "block long, n int, width int, ids binary, data binary"), name, "uncompressed")


def few_of_each(rows: DataFrame, k: int) -> DataFrame:
    """Of rows with equal vectors, those with the k + 1 least ids: no top k has room for more of them.

    A row that is repeated takes one place and is held once. Each task cuts its own rows down before they are dealt out by
    vector.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= k + 1).drop("place")
    return few.dropDuplicates(["vec_id", "embedding"])


def opened(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{prefix}ids"], "<i8")
    return ids, np.frombuffer(row[f"{prefix}data"], "<f8").reshape(len(ids), row[f"{prefix}width"])


def meeting(queries: DataFrame, held: DataFrame) -> DataFrame:
    """Each query block (columns q_...) beside each block of `held`.

    A pair is few bytes and much work, so the tasks are of a fixed number, which adaptive execution does not join by size.
    """
    salts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    copied = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).repartition(salts, "salt")
    dealt = held.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")).repartition(salts, "salt")
    return dealt.join(copied, "salt").drop("salt")


def least(rows: DataFrame, k: int, score: Column, by: str = "query_id", tie: str = "vec_id") -> DataFrame:
    """The k rows of each query with the least score, ties to the smaller id, as rank from 1."""
    from pyspark.sql import Window

    order = Window.partitionBy(by).orderBy(score, F.col(tie))
    return rows.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
