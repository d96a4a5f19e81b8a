"""Best-fit packing, planned over the histogram of piece lengths.

The driver packs counts, not documents: at most `size` lengths with their counts give a plan of runs
(length, ranks from-to) -> (sequences from, offset), whose size depends on `size` alone. Pieces then
take the slot that the plan holds for their rank within their length. No group is ever gathered.

Nulls: a null text is empty and yields its end id alone; a null id is kept. Repeated rows are packed
each for itself. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import land, lean, partition_id, pieces, ship

PIECE_SCHEMA = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, rank_in_part long"
)


def pieces_of(
    docs: DataFrame, vocabulary: str, id_col="doc_id", text_col="text", size=4096, end_id=1, keep_ids=False
) -> DataFrame:
    """Token pieces of at most `size` ids; ids are little-endian unsigned 32-bit, or null if not kept.

    part and rank_in_part number the pieces of one length within a task.
    """
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from flowlens.llm.tokens import encoder
        from flowlens.llm.words import split, texts

        encode, part = encoder(vocabulary), partition_id()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            data, offsets = texts(batch.column(1))
            for lo, hi in pieces(offsets):
                words = split(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                ids, counts = encode.encode(words, end_id)
                cuts = -(-counts // size)
                doc = np.repeat(np.arange(hi - lo), cuts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * size
                length = np.minimum(counts[doc] - start, size)
                begin = (np.cumsum(counts) - counts)[doc] + start
                raw = ids.astype("<u4").tobytes()
                spans = [raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order)) - np.searchsorted(ranked, ranked) + seen[ranked]
                seen += np.bincount(length, minlength=size + 1)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(0).slice(lo, hi - lo).take(pa.array(doc)),
                        "piece": pa.array(piece, pa.int32()),
                        "start": pa.array(start, pa.int64()),
                        "length": pa.array(length, pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(s) for s in spans], pa.int64()),
                        "ids": pa.array(spans if keep_ids else [None] * len(spans), pa.binary()),
                        "part": pa.array(np.full(len(doc), part), pa.int32()),
                        "rank_in_part": pa.array(rank, pa.int64()),
                    }
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(cut), PIECE_SCHEMA)


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int]]:
    """Best fit over counts, longest first: rows (length, first rank, first sequence, offset).

    Ranks from one row's first to the next row's of that length go to consecutive sequences, at one
    offset. Sequences with the same room form runs, so a step places a whole run.
    """
    room: list[int] = []  # rooms that some sequence has, ascending
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, count)
    out: list[tuple[int, int, int, int]] = []
    used = 0

    def open_run(left: int, first: int, count: int) -> None:
        if left and count:
            if left not in runs:
                bisect.insort(room, left)
                runs[left] = []
            runs[left].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            i = bisect.bisect_left(room, length)
            if i < len(room):
                left = room[i]
                first, count = runs[left].pop()
                if not runs[left]:
                    del runs[left]
                    room.pop(i)
            else:  # as many new sequences as these pieces fill
                left, first = size, used
                count = -(-todo // (size // length))
                used += count
            # As each next piece goes where least room is left, a sequence takes all it can at once.
            fits = min(left // length, todo)
            taken = min(count, todo // fits)
            for k in range(fits):
                out.append((length, rank, first, size - left + k * length))
                rank += taken
            todo -= fits * taken
            open_run(left - fits * length, first, taken)
            open_run(left, first + taken, count - taken)
    return out


def pack(
    docs: DataFrame, vocabulary: str, id_col="doc_id", text_col="text", size=4096, end_id=1, keep_ids=False
) -> DataFrame:
    """Pieces with their place: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset.

    Sequences hold at most `size` ids and are gapless from 0.
    """
    spark = docs.sparkSession
    cut = land(pieces_of(docs, vocabulary, id_col, text_col, size, end_id, keep_ids), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = sorted(plan(histogram, size))
    # Lengths and ranks as one ascending key; a length has fewer than 2**48 pieces.
    key = np.array([(a << 48) + b for a, b, _, _ in slots], np.int64)
    table = np.array([(b, c, d) for _, b, c, d in slots], np.int64).reshape(-1, 3)
    shared = spark.sparkContext.broadcast((key, table))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, table = shared.value
        for batch in batches:
            names = batch.schema.names
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(names.index("rank")).to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(key, (length << 48) + rank, "right") - 1]
            kept = {n: batch.column(names.index(n)) for n in names if n != "rank"}
            yield pa.record_batch(
                kept
                | {
                    "sequence_id": pa.array(row[:, 1] + rank - row[:, 0], pa.int64()),
                    "offset": pa.array(row[:, 2], pa.int64()),
                }
            )

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    ranked = cut.join(earlier, ["length", "part"]).select(
        *columns, (F.col("rank_in_part") + F.col("earlier")).alias("rank")
    )
    return ranked.mapInArrow(
        place,
        "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long",
    )
