"""Exact top-k inner products by the three-phase uniform threshold.

Vectors become integers, floor(scale * x). The score of a row is the sum over `slices` of its dimensions, and each slice
is a node with a score list of its own, held in blocks of rows.

1. Each node gathers its best partial scores, DEPTH * k of them, and its least one. The rows seen are few and are scored
   in full; the k-th best score is the first cutoff. It is safe, as k rows reach it.
2. The cutoff, less the sum of the least scores, is shared out evenly, so each node gets its least score plus an even share.
   It marks all entries that reach this. A row that reaches the cutoff in sum reaches its share in some node, so
   no answer is missed.
3. Marked rows are scored in full where they lie, as a block holds all slices of its rows; those that reach the cutoff
   are sent, and the best k of them are the answer.

The cutoffs of a query block go to all blocks with the block itself.

Of equal integer vectors only the k + 1 least ids are held, as no answer has room for more; this is exact.

Vectors null, or with null or non-finite components, take no part; nor do those with a null id. Equal ids: each row is a
candidate, of which a query's own id is none, and equal (query, id, score) count once. Shorter vectors are filled with zeros.
Ties go to the smaller id. An empty table, or one without queries, gives no rows. A vector whose integers have a sum of squares of
2**62 or more takes no part, so that every score fits into 64 bits. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import vectors
from flowlens.llm.common import land

SLICES = 2
# Phase 1 takes so many times k entries from each node: the more, the nearer its cutoff is to the k-th score.
DEPTH = 8


def exact_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows, by doubles where these are exact."""
    bound = (np.abs(a).max(initial=0)) * (np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    if bound < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    # Sums on the way may be larger than the product is.
    whole = [np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape) for m in (a, b)]
    return (whole[0] @ whole[1].T).astype(np.int64)


def _parts(width: int, slices: int) -> list[slice]:
    edges = np.linspace(0, width, slices + 1).astype(int).tolist()
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def _work(pairs: DataFrame, width: int, schema: str, one) -> DataFrame:
    """one(row, query ids, query integers, ids, integers) yields record batches for each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                (qid, q), (vid, v) = vectors.opened(row, "q_"), vectors.opened(row)
                yield from one(row, qid, _filled(q, width), vid, _filled(v, width))

    return pairs.mapInArrow(run, schema)


def _filled(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, max(0, width - m.shape[1]))))


ENTRY = "query_id long, vec_id long, slice int, part long"


def top_k(
    embeddings: DataFrame,
    is_query,
    k: int = 5,
    scale: int = 256,
    slices: int = SLICES,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a condition on vec_id."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & vectors.usable(F.col("embedding")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = rows.select("vec_id", whole.alias("embedding"))
    rows = rows.where(F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x * x) < 2.0**62)
    held = vectors.blocks(vectors.few_of_each(rows, k), vectors.BLOCK_ROWS, "vectors")
    width = held.agg(F.max("width").alias("w")).first()["w"] or 0
    asked = vectors.blocks(rows.where(is_query(F.col("vec_id"))).dropDuplicates(), vectors.QUERY_ROWS, "queries")
    pairs = vectors.meeting(asked, held)

    def best(row, qid, q, vid, v):
        """Phase 1: the best k of each slice in this block; as vec_id -1, the least of the slice."""
        for s, part in enumerate(_parts(q.shape[1], slices)):
            scores = exact_dot(q[:, part], v[:, part])
            low = scores.min(axis=1)
            own = qid[:, None] == vid[None, :]
            masked = np.where(own, np.iinfo(np.int64).min, scores)
            take = min(DEPTH * k, len(vid))
            at = np.argpartition(-masked.astype(np.float64), take - 1, axis=1)[:, :take]
            value = np.take_along_axis(masked, at, 1)
            real = ~np.take_along_axis(own, at, 1)
            query = np.repeat(qid, take).reshape(at.shape)
            yield _entries(
                np.concatenate([query[real], qid]),
                np.concatenate([vid[at][real], np.full(len(qid), -1)]),
                s,
                np.concatenate([value[real], low]),
                np.concatenate([np.zeros(int(real.sum()), bool), np.ones(len(qid), bool)]),
            )

    first = land(_work(pairs, width, ENTRY + ", floor boolean", best), "phase1")
    floors = first.where("floor").groupBy("query_id", "slice").agg(F.min("part").alias("low"))
    seen = vectors.least(
        first.where("NOT floor").withColumn("list", F.struct("query_id", "slice")), DEPTH * k, -F.col("part"), by="list"
    ).select("query_id", "vec_id").distinct()
    lows = floors.groupBy("query_id").agg(F.sum("low").alias("low_sum"))
    query_rows = rows.where(is_query(F.col("vec_id"))).dropDuplicates()
    cut = _cutoff(_scored(seen, rows, query_rows), lows, k)
    # Even shares, rounded down: they sum to the cutoff at most.
    share = F.floor((F.col("cutoff") - F.col("low_sum")) / F.lit(slices)).cast("long")
    limits = floors.join(lows.join(cut, "query_id"), "query_id").select(
        "query_id", "slice", (F.col("low") + F.greatest(share, F.lit(0))).alias("limit")
    )
    whole_cut = cut.select("query_id", F.lit(slices).alias("slice"), F.col("cutoff").alias("limit"))
    by_query = limits.unionByName(whole_cut).groupBy("query_id").agg(
        F.map_from_entries(F.collect_list(F.struct("slice", "limit"))).alias("m")
    )
    told = _told(asked, by_query, slices + 1)

    def reach(row, qid, q, vid, v):
        """Phase 2: entries that reach the limit of a node. Phase 3: their scores in full, if they reach the cutoff."""
        limit = np.frombuffer(row["q_limits"], "<i8").reshape(len(qid), slices + 1)
        parts = [exact_dot(q[:, part], v[:, part]) for part in _parts(q.shape[1], slices)]
        marked = qid[:, None] != vid[None, :]
        marked &= np.logical_or.reduce([p >= limit[:, s, None] for s, p in enumerate(parts)])
        i, j = np.nonzero(marked)
        score = sum(p[i, j] for p in parts)
        good = score >= limit[i, slices]
        yield pa.record_batch(
            {
                "query_id": pa.array(qid[i[good]], pa.int64()),
                "vec_id": pa.array(vid[j[good]], pa.int64()),
                "score": pa.array(score[good], pa.int64()),
            }
        )

    scored = _work(vectors.meeting(told, held), width, "query_id long, vec_id long, score long", reach)
    # Queries with fewer candidates than k have limits at their least scores, so they get them all.
    return vectors.least(scored.distinct(), k, -F.col("score")).select("query_id", "rank", "vec_id", "score")


def _entries(query, vec, s, part, floor) -> pa.RecordBatch:
    columns = {
        "query_id": pa.array(query, pa.int64()),
        "vec_id": pa.array(vec, pa.int64()),
        "slice": pa.array(np.full(len(query), s), pa.int32()),
        "part": pa.array(part, pa.int64()),
    }
    return pa.record_batch(columns | ({"floor": pa.array(floor)} if floor is not None else {}))


def _scored(pairs: DataFrame, rows: DataFrame, query_rows: DataFrame) -> DataFrame:
    """query_id, vec_id, score of pairs, in full; equal ids with other vectors give a row each."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q, v = vectors.widened(vectors.matrix(batch.column(2)), vectors.matrix(batch.column(3)))
                exact = (np.abs(q).max(initial=0)) * (np.abs(v).max(initial=0)) * max(1, q.shape[1]) < 2**53
                total = (q * v).sum(1).astype(np.int64) if exact else np.array(
                    [exact_dot(q[i : i + 1], v[i : i + 1])[0, 0] for i in range(len(q))], np.int64
                )
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(total)], ["query_id", "vec_id", "score"])

    full = pairs.join(rows.select("vec_id", F.col("embedding").alias("v")), "vec_id").join(
        query_rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id"
    )
    return full.select("query_id", "vec_id", "q", "v").mapInArrow(score, "query_id long, vec_id long, score long")


def _cutoff(scored: DataFrame, lows: DataFrame, k: int) -> DataFrame:
    """query_id, cutoff: the k-th best score of the rows seen, or the least sum if there are fewer."""
    kept = vectors.least(scored.distinct(), k, -F.col("score")).groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("cutoff")
    )
    return lows.join(kept, "query_id", "left").select("query_id", F.coalesce("cutoff", "low_sum").alias("cutoff"))


def _told(asked: DataFrame, limits: DataFrame, slices: int) -> DataFrame:
    """Query blocks with each query's limits; the limits of a block's queries go to it by its number."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                yield pa.record_batch(
                    {
                        "block": pa.array(np.full(len(ids), row["block"]), pa.int64()),
                        "place": pa.array(np.arange(len(ids)), pa.int32()),
                        "query_id": pa.array(ids, pa.int64()),
                    }
                )

    placed = asked.select("block", "ids").mapInArrow(names, "block long, place int, query_id long").join(limits, "query_id")
    each = F.array(*[F.coalesce(F.element_at("m", F.lit(s)), F.lit(0)).cast("long") for s in range(slices)])
    gathered = placed.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", each.alias("l")))).alias("all"))

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limits = [
                np.array([r["l"] for r in every], "<i8").tobytes() for every in batch.column(batch.num_columns - 1).to_pylist()
            ]
            yield pa.record_batch([*batch.columns[:-1], pa.array(limits, pa.binary())], [*batch.schema.names[:-1], "limits"])

    joined = asked.join(gathered, "block").select(*asked.columns, "all")
    return land(
        joined.mapInArrow(flatten, "block long, n int, width int, ids binary, data binary, limits binary"), "told", "uncompressed"
    )
