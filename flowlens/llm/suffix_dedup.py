"""Substring dedup: words in a window of `size` words that also starts in a document with a smaller id go.

The work is done by suffix automata of reference shards, past which documents stream for their matching
statistics. As documents are one another's references, automata of whole texts would hold the corpus, and each
document would meet all of them. So, first, only text that can match is routed:

1. The least hash of the 6-word sequences in a window is the same wherever the window stands. Windows whose least
   hash lies in one document only cannot repeat and leave here; all others stay.
2. Of these, each window's 64-bit hash gives the least document that has it. A run of windows in that document is a
   reference passage; the runs of other documents stream past the shard that holds their reference.
3. A shard's passages form one automaton, which goes to the tasks that stream its runs. It compares words, not hashes,
   and decides what is removed. Shards hold SHARD_WORDS words about; a shard's runs are cut into parts of
   STREAM_WORDS words, so a passage that a third of all documents share streams in many tasks.

Automata together grow with the data, so they travel by a join on the shard instead of a broadcast to all.

Nulls: a null text has no words. A document with a null id is never a reference, and keeps its words. Equal ids: no
document is smaller than another with its id. Each row gives one row. An empty table gives no rows. A very long text is a
chunk by itself and is treated whole; the passages that one document lends to others make one automaton. Other columns are
not looked at, and stay as they are in `deduplicate`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import tally
from flowlens.llm.common import land, lean, lean_group, packed_size, packed_texts, thawed, whole_rows

U64 = np.uint64
SIZE = 13
# Tasks that automata are built in, at most.
MAX_TASKS = 4096
ANCHOR = 6
ANCHOR_BITS = 48
SHARD_WORDS, STREAM_WORDS = 100_000, 400_000
_SIGN = U64(1 << 63)


class _Chunk:
    """Words and windows of a chunk."""

    def __init__(self, blob: bytes, size: int):
        from flowlens.llm.words import split, texts

        self.table, self.size = thawed(blob), size
        data, offsets = texts(self.table.column("__text"))
        self.words = split(data, offsets)
        ids = self.table.column("__id").combine_chunks()
        self.known = ~np.asarray(ids.is_null())
        self.ids = ids.fill_null(0).to_numpy()
        self.per_doc = self.words.per_doc()
        self.first = np.cumsum(self.per_doc) - self.per_doc

    def look(self) -> None:
        """Find all windows: at (their first words), window (hashes), anchor, doc."""
        from flowlens.llm.words import grams

        size, hashes = self.size, self.words.hashes()
        anchor = min(ANCHOR, size)
        at, value = grams(hashes, self.words.doc, anchor)
        least = np.full(max(0, len(hashes) - anchor + 1), ~U64(0))
        least[at] = value
        span, step = size - anchor + 1, 1
        while step < span:  # the least of `span` neighbours, by doubling
            move = min(step, span - step)
            least = np.minimum(least[:-move], least[move:]) if len(least) > move else least[:0]
            step += move
        self.at, self.window = grams(hashes, self.words.doc, size)
        keep = self.known[self.words.doc[self.at]]
        self.at, self.window = self.at[keep], self.window[keep]
        self.anchor = least[self.at] >> U64(64 - ANCHOR_BITS)
        self.doc = self.words.doc[self.at]

    def repeated(self, totals: np.ndarray) -> None:
        """Find the windows whose anchor occurs in more than one document."""
        self.look()
        keys = np.unique(self.anchor)
        keep = totals[np.searchsorted(keys, self.anchor)] > 1
        self.at, self.window, self.doc = self.at[keep], self.window[keep], self.doc[keep]

    def text(self, start: int, end: int) -> bytes:
        return self.words.data[self.words.start[start] : self.words.end[end - 1]].tobytes()


def _anchors(packed: DataFrame, size: int, cut: int) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = _Chunk(blob, size)
                c.look()
                order = np.lexsort((c.doc, c.anchor))
                key, doc = c.anchor[order], c.doc[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                keys, docs = np.unique(key[new], return_counts=True)
                yield from tally.requests(chunk, keys, docs, ANCHOR_BITS, cut)

    return packed.select("chunk", "blob").mapInArrow(lean(ask), tally.REQUEST)


ROLE = "owner long, doc long, text binary, chunk long, place int, start int, n_words int"


def _runs(packed: DataFrame, size: int) -> DataFrame:
    """Reference passages (owner = own id, chunk null) and runs to stream (owner = the reference)."""
    _, n_bytes = packed_size(packed)
    cut = tally.bucket_bits(n_bytes // 24)
    shared = land(tally.answers(_anchors(packed, size, cut)), "anchors")

    def ask(chunk: int, blob: bytes, totals: np.ndarray) -> Iterator[pa.RecordBatch]:
        c = _Chunk(blob, size)
        c.repeated(totals)
        ids = c.ids[c.doc].view(U64) ^ _SIGN
        keys, which = np.unique(c.window, return_inverse=True)
        order = np.lexsort((ids, which))
        starts = np.flatnonzero(np.diff(which[order], prepend=-1))
        ends = np.append(starts, len(order))[1:] - 1
        sorted_ids = ids[order]
        yield from tally.requests(chunk, keys, sorted_ids[starts], 64, cut, sorted_ids[ends])

    owners = land(tally.answers(tally.answered(packed, [shared], ask, tally.REQUEST), least=True), "owners")

    def runs(chunk: int, blob: bytes, totals: np.ndarray, least: np.ndarray) -> Iterator[pa.RecordBatch]:
        c = _Chunk(blob, size)
        c.repeated(totals)
        keys = np.unique(c.window)
        found = least[np.searchsorted(keys, c.window)]
        several = found != tally.NONE
        at, doc = c.at[several], c.doc[several]
        owner = (found[several] ^ _SIGN).view(np.int64)
        # Runs of neighbouring windows of one document with one owner.
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first, len(owner))[1:] - 1
        out = [[] for _ in range(7)]
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            begin, end, d = int(at[a]), int(at[b]) + size, int(doc[a])
            me = int(c.ids[d])
            of = None if me == int(owner[a]) else chunk
            row = (int(owner[a]), me, c.text(begin, end), of, d, begin - int(c.first[d]), end - begin)
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        names = [f.split()[0] for f in ROLE.split(", ")]
        yield pa.record_batch([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)

    return land(tally.answered(packed, [shared, owners], runs, ROLE), "runs")


def _removed(runs: DataFrame, size: int) -> DataFrame:
    """chunk, place, starts: windows to remove, as the automata find them."""
    wanted = runs.where("chunk IS NOT NULL")
    asked = wanted.groupBy("owner").agg(F.sum("n_words").alias("streamed"))
    passages = runs.where("chunk IS NULL").select("owner", "text", "n_words")
    words = passages.agg(F.sum("n_words").alias("n")).first()["n"] or 0
    shards = max(1, words // SHARD_WORDS)
    shard = F.pmod(F.xxhash64("owner"), F.lit(shards)).cast("int")

    def build(rows: pa.Table) -> pa.Table:
        from flowlens.llm.automaton import Automaton

        found = sorted(zip(rows.column("owner").to_pylist(), rows.column("text").to_pylist(), strict=True))
        made = Automaton.build(found)
        return pa.table({"shard": rows.column("shard")[:1], "automaton": pa.array([made.dump()], pa.binary())})

    # A shard is few bytes and much work, so the tasks are of a fixed number, which adaptive execution does not join by size.
    tasks = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(shards, MAX_TASKS))
    automata = passages.select(shard.alias("shard"), "owner", "text").repartition(tasks, "shard").groupBy("shard").applyInArrow(
        lean_group(build), "shard int, automaton binary"
    )
    automata = land(automata, "automata", "uncompressed")
    parts = asked.groupBy(shard.alias("shard")).agg(
        F.ceil(F.sum("streamed") / F.lit(STREAM_WORDS)).cast("int").alias("parts")
    )
    dealt = wanted.withColumn("shard", shard).join(parts, "shard")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("chunk", "place", "start"), F.col("parts")).cast("int"))
    dealt = dealt.select("shard", "part", "text", "chunk", "place", "start", "doc")
    spread = automata.join(parts, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "automaton"
    )

    def stream(left: pa.Table, right: pa.Table) -> pa.Table:
        from flowlens.llm.automaton import Automaton

        out = [[], [], []]
        if left.num_rows and right.num_rows:
            held = Automaton.load(right.column("automaton")[0].as_py())
            names = ("text", "chunk", "place", "start", "doc")
            for text, chunk, place, start, doc in zip(*(left.column(n).to_pylist() for n in names), strict=True):
                hits = held.windows(text.split(), doc, size)
                if hits:
                    out[0].append(chunk)
                    out[1].append(place)
                    out[2].append([start + h for h in hits])
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()))
        return pa.table([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["chunk", "place", "starts"])

    both = dealt.groupBy("shard", "part").cogroup(spread.groupBy("shard", "part"))
    return both.applyInArrow(stream, "chunk long, place int, starts array<int>")


def _kept(packed: DataFrame, size: int, emit, schema: str) -> DataFrame:
    """emit(chunk, keep) for each chunk, with a flag for each of its words."""
    removed = _removed(_runs(packed, size), size)
    by_chunk = removed.groupBy("chunk").agg(F.collect_list(F.struct("place", "starts")).alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = _Chunk(batch.column(0)[i].as_py(), size)
                gone = batch.column(1)[i]
                keep = np.ones(len(c.words) + 1, np.int64)
                if gone.is_valid:
                    place = gone.values.field("place").to_numpy()
                    starts = gone.values.field("starts")
                    counts = starts.value_lengths().to_numpy()
                    at = starts.flatten().to_numpy() + np.repeat(c.first[place], counts)
                    edge = np.zeros(len(keep), np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + size, -1)
                    keep = np.cumsum(edge)[: len(keep)] == 0
                yield from emit(c, keep[: len(c.words)].astype(bool))

    return packed.join(by_chunk, "chunk", "left").select("blob", "gone").mapInArrow(lean(run), schema)


def _texts(c: _Chunk, keep: np.ndarray) -> list[bytes]:
    """Kept words of each document, joined by one space."""
    kept = np.flatnonzero(keep)
    words = c.words.values(kept)
    ends = np.searchsorted(c.words.doc[kept], np.arange(c.words.n_docs), "right").tolist()
    return [b" ".join(words[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def removed_words(docs: DataFrame, id_col="doc_id", text_col="text", size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, text: what is left of each document."""
    packed = packed_texts(docs, id_col, text_col, "texts")

    def emit(c: _Chunk, keep: np.ndarray) -> Iterator[pa.RecordBatch]:
        left = _texts(c, keep)
        gone = np.bincount(c.words.doc[~keep], minlength=c.words.n_docs)
        yield pa.record_batch(
            {
                "doc_id": c.table.column("__id").combine_chunks(),
                "n_words": pa.array(c.per_doc, pa.int64()),
                "n_removed": pa.array(gone, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in left], pa.string()),
                "text": pa.array([t.decode("utf-8", "replace") for t in left], pa.string()),
            }
        )

    return _kept(packed, size, emit, "doc_id long, n_words long, n_removed long, kept_sha256 string, text string")


def deduplicate(docs: DataFrame, id_col="doc_id", text_col="text", size: int = SIZE) -> DataFrame:
    """Documents with all their columns. A text that loses words is its kept words joined by one space; one that
    loses all its words goes."""
    packed = packed_texts(docs, id_col, text_col, "texts", keep_columns=True)
    columns = docs.columns

    def emit(c: _Chunk, keep: np.ndarray) -> Iterator[pa.RecordBatch]:
        gone = np.bincount(c.words.doc[~keep], minlength=c.words.n_docs)
        left = [t.decode("utf-8", "replace") for t in _texts(c, keep)]
        old = c.table.column("__text").to_pylist()
        new = [n if g else o for n, o, g in zip(left, old, gone.tolist(), strict=True)]
        stay = (gone < c.per_doc) | (c.per_doc == 0)
        yield from whole_rows(c.table, columns, text_col, pa.array(new, pa.string()), stay)

    return _kept(packed, size, emit, docs.schema)
