"""Approximate nearest neighbours by multi-index hashing.

Codes: vectors are centred, turned to their principal axes, and rotated so that signs lose least (iterative
quantization); several rotations, each from its own start, give BITS bits. This is fitted on SAMPLE rows with
the least hash of their id. On the same sample the Hamming radius is set to hold RECALL of true neighbour pairs; as the
table grows beyond the sample, neighbours come closer and the radius holds more of them.

Index: a code is cut into substrings of 16 bits; each block of rows keeps, for each substring, its distinct values and the rows
that have them. Every row is indexed. By the pigeonhole principle a code within radius r of a query agrees on some
substring up to floor(r / substrings) bits, so probing all values that near in each substring retrieves every code within r.
Retrieved codes are checked against r as a whole, and the rest reranked by Euclidean distance of the original vectors.

A query that finds fewer than k rows within the radius is asked again with the radius of the whole code, which holds all
rows. There are no caps on buckets: probing yields all rows of a value. Of equal vectors only the k + 1 least ids are
held, as no answer has room for more; this is exact.

Vectors null, zero, empty, or with null or non-finite components, or a null id, take no part. A query's own id is no candidate.
Equal rows count once. Shorter vectors are filled with zeros. Ties go to the smaller id. An empty table, or one without queries,
gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import vectors
from flowlens.llm.common import land

BITS, SUBSTRING = 256, 16
SAMPLE, SAMPLE_QUERIES = 8192, 512
RECALL = 0.97
_ONES = np.array([bin(i).count("1") for i in range(1 << SUBSTRING)], np.uint8)


@dataclass
class Codes:
    mean: np.ndarray
    turn: np.ndarray  # (dimensions, bits)
    radius: int

    def of(self, x: np.ndarray) -> np.ndarray:
        """(rows, substrings) of 16 bits each."""
        x = np.pad(x, ((0, 0), (0, max(0, len(self.mean) - x.shape[1]))))[:, : len(self.mean)]
        bits = ((x - self.mean) @ self.turn) >= 0
        return np.packbits(bits, axis=1).view("<u2")


def fit(sample: np.ndarray, k: int, bits: int = BITS, recall: float = RECALL, seed: int = 5) -> Codes:
    rng = np.random.Generator(np.random.PCG64(seed))
    mean = sample.mean(axis=0)
    x = sample - mean
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :bits]
    v = x @ axes
    turns = []
    while sum(t.shape[1] for t in turns) < bits:
        r, _ = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))
        for _ in range(20):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = w.T @ u.T
        turns.append(axes @ r)
    codes = Codes(mean, np.concatenate(turns, axis=1)[:, :bits], bits)
    if len(sample) > 1:
        asked = sample[:SAMPLE_QUERIES]
        near = np.argsort(distances(asked, sample), axis=1, kind="stable")[:, 1 : k + 1]
        have = codes.of(sample)
        apart = _ONES[have[: len(asked), None, :] ^ have[near]].sum(axis=2, dtype=np.int64)
        codes.radius = int(np.quantile(apart, recall, method="higher"))
    return codes


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared, for choosing only."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def probes(radius: int, parts: int) -> list[int]:
    """Bits that each substring may differ by: if all differed by more, the code would by more than radius."""
    whole, rest = divmod(radius, parts)
    return [whole if j <= rest else whole - 1 for j in range(parts)]


def _indexed(held: DataFrame, codes: Codes) -> DataFrame:
    """Blocks with their codes and, for each substring, rows ordered by its value."""
    shared = held.sparkSession.sparkContext.broadcast(codes)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.of(vectors.opened(row)[1]) for row in batch.to_pylist()]
            order = [np.argsort(c, axis=0, kind="stable").astype("<u4").T for c in found]
            yield pa.record_batch(
                [
                    *batch.columns,
                    pa.array([c.tobytes() for c in found], pa.binary()),
                    pa.array([np.ascontiguousarray(o).tobytes() for o in order], pa.binary()),
                ],
                [*batch.schema.names, "codes", "postings"],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema)
    return land(held.mapInArrow(index, f"{schema}, codes binary, postings binary"), "index", "uncompressed")


def retrieved(query: np.ndarray, codes: np.ndarray, postings: np.ndarray, radius: int) -> np.ndarray:
    """Rows of a block whose codes lie within the radius, by probing each substring's index."""
    hit = np.zeros(len(codes), bool)
    for j, reach in enumerate(probes(radius, codes.shape[1])):
        if reach < 0:
            continue
        rows = postings[j]
        values = codes[rows, j]
        starts = np.flatnonzero(np.diff(values.astype(np.int64), prepend=-1))
        near = _ONES[values[starts] ^ query[j]] <= reach
        hit[rows[np.repeat(near, np.diff(np.append(starts, len(rows))))]] = True
    some = np.flatnonzero(hit)
    return some[_ONES[codes[some] ^ query].sum(axis=1, dtype=np.int64) <= radius]


def _search(asked: DataFrame, index: DataFrame, codes: Codes, radius: int, k: int) -> DataFrame:
    shared = asked.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                (qid, q), (vid, v) = vectors.opened(row, "q_"), vectors.opened(row)
                have = np.frombuffer(row["codes"], "<u2").reshape(len(vid), -1)
                postings = np.frombuffer(row["postings"], "<u4").reshape(have.shape[1], len(vid))
                want = shared.value.of(q)
                q, v = vectors.widened(q, v)
                out = []
                for one, vector, code in zip(qid, q, want, strict=True):
                    found = retrieved(code, have, postings, radius)
                    found = found[vid[found] != one]
                    far = np.sqrt(((v[found] - vector) ** 2).sum(axis=1))
                    if len(found) > 4 * k:  # all that can be among the best k, ties too
                        close = far <= np.partition(far, k - 1)[k - 1]
                        found, far = found[close], far[close]
                    best = np.lexsort((vid[found], far))[:k]
                    out.append((np.full(len(best), one), vid[found[best]], far[best]))
                yield pa.record_batch(
                    {
                        "query_id": pa.array(np.concatenate([o[0] for o in out]), pa.int64()),
                        "vec_id": pa.array(np.concatenate([o[1] for o in out]), pa.int64()),
                        "score": pa.array(np.concatenate([o[2] for o in out]), pa.float64()),
                    }
                )

    pairs = vectors.meeting(asked, index)
    found = pairs.mapInArrow(run, "query_id long, vec_id long, score double").distinct()
    return vectors.least(found, k, F.col("score")).select("query_id", "rank", "vec_id", "score")


def search(
    embeddings: DataFrame, is_query, k: int = 10, id_col="vec_id", vector_col="embedding", sample: int = SAMPLE
) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a condition on vec_id."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    rows = rows.where(
        F.col("vec_id").isNotNull()
        & vectors.usable(F.col("embedding"))
        & F.exists("embedding", lambda x: x != F.lit(0))
    )
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
    spark = embeddings.sparkSession
    if not drawn.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codes = fit(vectors.matrix(drawn.column(0)), k)
    index = _indexed(vectors.blocks(vectors.few_of_each(rows, k), vectors.BLOCK_ROWS, "vectors"), codes)
    queries = rows.where(is_query(F.col("vec_id"))).dropDuplicates()
    found = land(_search(vectors.blocks(queries, vectors.QUERY_ROWS, "queries"), index, codes, codes.radius, k), "found")
    enough = found.where(F.col("rank") == k).select("vec_id", F.col("query_id")).select(F.col("query_id").alias("vec_id"))
    short = land(queries.join(enough, "vec_id", "left_anti"), "short")
    if short.isEmpty():
        return found
    again = _search(vectors.blocks(short, vectors.QUERY_ROWS, "queries"), index, codes, BITS, k)
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select(
        "query_id", "rank", "vec_id", "score"
    ).unionByName(again)
