"""Ranked lexical search by presence masks.

Terms are the longest runs of ASCII letters, digits and characters beyond ASCII in the whole text, A-Z in lower case.
N documents have a term, L is the number of all their terms, n that of one document, df the documents with a term, tf
its occurrences in one. The weight w of a term is floor(1000 * ln((2N+2) / (2df+1))), a document's m is
75 + (25*n*N) div L, and its score for an item is the sum, over the item's terms with repeats, of
w * ((10**9 * tf) div (1000*tf + 12*m)).

One pass over the texts lands an index: for chunks of neighbouring rows, the postings of the terms that items have. Counts
come from its term columns. Then, in each chunk and for each item, the terms' bitmaps give every document a mask of the
terms that it has; documents of one mask are a group, whose score is at most the sum of its terms' largest parts in the
chunk. Groups are scored by descending maximum, until it is below the k-th best score that the task has found so far;
equal maxima still count, as a smaller doc_id wins ties. A task keeps k documents of an item, and these are ranked
together in the end. No document's score leaves its task otherwise.

Items are taken in blocks of at most BLOCK_BYTES of text, or one longer text; each block's terms are broadcast.

Null and empty texts, and texts without a term, have no terms: as documents they are not counted, as items they have no
rows. Equal rows of items are one item; texts that share an item_id are ranked each by itself. Each row of documents is a
document; repeated rows take a rank each. A null doc_id comes after all others of its score. Empty tables give no rows.
Other columns are not looked at. Sums are 64-bit; the product 25*n*N is not bound to them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import frozen, land, lean, pieces, ship, thawed

BLOCK_BYTES = 2 << 20
CHUNK_BYTES = 4 << 20
# Bits of a mask that one number holds exactly while it is summed up in doubles.
WORD_BITS = 48
# Documents scored at once, at least.
STEP = 64
NO_ID = np.iinfo(np.int64).max
INDEX = "blob binary, term array<int>, df array<int>, n_docs long, n_terms long"

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def terms_of(column: pa.Array):
    """Terms of a text column in lower case, as words."""
    from flowlens.llm.words import lowered, split, texts

    data, offsets = texts(column)
    return split(lowered(data), offsets, _BETWEEN)


class Items:
    """Distinct terms of a block of items, and of each item its terms and their repeats."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        self.words = terms_of(pa.array([r[1] for r in rows], pa.string()))
        seen: dict[bytes, int] = {}
        values = self.words.values(np.arange(len(self.words)))
        number = np.array([seen.setdefault(v, len(seen)) for v in values], np.int64)
        first = np.zeros(len(seen), np.int64)
        first[number[::-1]] = np.arange(len(number))[::-1]
        hashes = self.words.hashes()[first]
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.first = hashes[order], first[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.terms = [
            np.unique(place[number[self.words.doc == i]], return_counts=True) for i in range(len(rows))
        ]

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, words) -> tuple[np.ndarray, np.ndarray]:
        """Words that are terms of items, and which; equal hashes count if the bytes are equal."""
        hashes = words.hashes()
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self) - 1, 0))
        hit = np.flatnonzero(self.hashes[at] == hashes) if len(self) else np.zeros(0, np.int64)
        at = at[hit]
        return (same := hit[_equal(words, hit, self.words, self.first[at])]), at[np.isin(hit, same, assume_unique=True)]


def _equal(a, i: np.ndarray, b, j: np.ndarray) -> np.ndarray:
    """Whether words i of a and j of b have the same bytes."""
    from flowlens.llm.words import _KEEP

    length = a.end[i] - a.start[i]
    same = length == b.end[j] - b.start[j]
    loads = []
    for words in (a, b):
        padded = np.concatenate([words.data, np.zeros(8, np.uint8)])
        loads.append(np.ndarray((len(words.data) + 1,), "<u8", padded, strides=(1,)))
    live, step = np.flatnonzero(same & (length > 0)), 0
    while len(live):
        keep = _KEEP[np.minimum(length[live] - step, 8)]
        apart = ((loads[0][a.start[i[live]] + step] ^ loads[1][b.start[j[live]] + step]) & keep) != 0
        same[live[apart]] = False
        step += 8
        live = live[~apart]
        live = live[length[live] > step]
    return same


def _indexed(docs: DataFrame, items) -> DataFrame:
    """INDEX of chunks; a blob holds the ids and lengths of its documents, and postings by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            from flowlens.llm.words import texts

            _, offsets = texts(batch.column(1))
            for lo, hi in pieces(offsets, CHUNK_BYTES):
                yield _chunk(batch.column(0).slice(lo, hi - lo), terms_of(batch.column(1).slice(lo, hi - lo)), items.value)

    return docs.mapInArrow(lean(run), INDEX)


def _chunk(names: pa.Array, words, items: Items) -> pa.RecordBatch:
    length = words.per_doc()
    which, term = items.find(words)
    key, tf = np.unique(term * len(names) + words.doc[which], return_counts=True)
    term, place = np.divmod(key, max(len(names), 1))
    found, first = np.unique(term, return_index=True)
    df = np.diff(np.append(first, len(term)))
    rows = pa.record_batch(
        {
            "doc_id": pa.array([names.to_numpy(zero_copy_only=False) if not names.null_count else names.to_pylist()], pa.list_(pa.int64())),
            "n": pa.array([length], pa.list_(pa.int64())),
            "term": pa.array([found], pa.list_(pa.int32())),
            "df": pa.array([df], pa.list_(pa.int32())),
            "place": pa.array([place], pa.list_(pa.int32())),
            "tf": pa.array([tf], pa.list_(pa.int32())),
        }
    )
    return pa.record_batch(
        {
            "blob": pa.array([frozen(rows)], pa.binary()),
            "term": rows.column("term"),
            "df": rows.column("df"),
            "n_docs": pa.array([np.count_nonzero(length)], pa.int64()),
            "n_terms": pa.array([length.sum()], pa.int64()),
        }
    )


class Ranking:
    """The k best documents of each item so far."""

    def __init__(self, items: Items, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
        self.items, self.n_docs, self.n_terms, self.k = items, n_docs, n_terms, k
        self.weights = [repeats * weights[terms] for terms, repeats in items.terms]
        none = np.zeros(0, np.int64)
        self.best = [(none, none) for _ in items.ids]
        self.scored = 0

    def _m(self, n: np.ndarray) -> np.ndarray:
        if len(n) and 25 * int(n.max()) * self.n_docs >= 1 << 63:
            return np.array([75 + 25 * x * self.n_docs // self.n_terms for x in n.tolist()], np.int64)
        return 75 + 25 * n * self.n_docs // max(self.n_terms, 1)

    def take(self, blob: bytes) -> None:
        rows = thawed(blob)
        names, n, found, df, place, tf = (rows.column(c).combine_chunks().flatten() for c in ("doc_id", "n", "term", "df", "place", "tf"))
        names = names.fill_null(NO_ID).to_numpy()
        found, df, place, tf = (x.to_numpy().astype(np.int64) for x in (found, df, place, tf))
        if not len(found):
            return
        part = (10**9 * tf) // (1000 * tf + 12 * self._m(n.to_numpy())[place])
        end = np.cumsum(df)
        first = end - df
        most = np.maximum.reduceat(part, first)
        held = np.full(len(self.items), -1)
        held[found] = np.arange(len(found))
        for i, (terms, _) in enumerate(self.items.terms):
            at = held[terms]
            has = at >= 0
            if has.any():
                at, weight = at[has], self.weights[i][has]
                self._rank(i, names, weight, weight * most[at], first[at], df[at], place, part)

    def _rank(self, i: int, names, weight, most, first, count, place, part) -> None:
        # Postings of the item's terms, one term after another.
        stop = np.cumsum(count)
        posting = np.arange(int(stop[-1])) + np.repeat(first - (stop - count), count)
        doc, term = place[posting], np.repeat(np.arange(len(first)), count)
        # Masks: bitmaps of the terms, a bit each, joined; words of them are told apart in turn.
        group = np.zeros(len(names), np.int64)
        for lo in range(0, len(first), WORD_BITS):
            a, b = stop[lo] - count[lo], stop[min(lo + WORD_BITS, len(first)) - 1]
            word = np.bincount(doc[a:b], np.ldexp(1.0, term[a:b] - lo), len(names))
            values, which = np.unique(word, return_inverse=True)
            _, group = np.unique(group * len(values) + which, return_inverse=True)
        size = np.bincount(group)
        sample = np.empty(len(size), np.int64)
        sample[group] = np.arange(len(names))
        # The most that a mask can score: of a document with it, all terms at their most.
        maximum = np.zeros(len(names), np.int64)
        mine = sample[group[doc]] == doc
        np.add.at(maximum, doc[mine], most[term[mine]])
        maximum = maximum[sample]
        order = np.argsort(-maximum, kind="stable")
        ids, scores = self.best[i]
        done, value = 0, weight[term] * part[posting]
        while done < len(order):
            least = max(int(scores[-1]) if len(scores) == self.k else 1, 1)
            reach = int(np.searchsorted(-maximum[order], -least, "right"))  # groups that may hold a better one
            if done >= reach:
                break
            upto = min(reach, done + int(np.searchsorted(np.cumsum(size[order[done:reach]]), STEP)) + 1)
            chosen = np.zeros(len(size), bool)
            chosen[order[done:upto]] = True
            pick = chosen[group[doc]]
            score = np.zeros(len(names), np.int64)
            np.add.at(score, doc[pick], value[pick])
            docs = np.flatnonzero(chosen[group] & (score > 0))
            self.scored += len(docs)
            ids, scores = np.concatenate([ids, names[docs]]), np.concatenate([scores, score[docs]])
            keep = np.lexsort((ids, -scores))[: self.k]
            ids, scores, done = ids[keep], scores[keep], upto
        self.best[i] = ids, scores

    def rows(self) -> pa.RecordBatch:
        item = np.repeat(np.arange(len(self.best)), [len(b[0]) for b in self.best])
        ids = np.concatenate([np.zeros(0, np.int64), *(b[0] for b in self.best)])
        scores = np.concatenate([np.zeros(0, np.int64), *(b[1] for b in self.best)])
        return pa.record_batch(
            {"item": pa.array(item, pa.int32()), "doc_id": pa.array(ids, mask=ids == NO_ID), "score": pa.array(scores)}
        )


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col="doc_id", text_col="text", item_col="item_id",
    item_text_col="text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of each item that score highest."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    asked = asked.where(F.col("text").isNotNull()).distinct()
    size = asked.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    blocks = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = None
    for number in range(blocks):
        part = _ranked(rows, Items([tuple(r) for r in asked.where(block == number).orderBy("item_id", "text").collect()]), k)
        found = part if found is None else found.unionByName(part)
    return found


def _ranked(docs: DataFrame, items: Items, k: int) -> DataFrame:
    """Of one block of items."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(items)
    index = land(_indexed(docs, shared), "postings", "uncompressed")
    totals = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("t")).first()
    n_docs, n_terms = totals["n"] or 0, totals["t"] or 0
    counted = index.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df"))
    weights = np.zeros(len(items), np.int64)
    for row in counted.collect():  # as many as the items have terms
        weights[row["term"]] = weight(n_docs, row["df"])
    weighed = spark.sparkContext.broadcast(weights)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranking = Ranking(shared.value, weighed.value, n_docs, n_terms, k)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                ranking.take(blob)
        yield ranking.rows()

    best = index.select("blob").mapInArrow(lean(rank), "item int, doc_id long, score long")
    order: list[Column] = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(items.ids)), "item int, item_id long")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
