"""Alignment of two tokenizers' tokens by interval coalescing.

Tokenizer A (tokenizers, byte-level) encodes a space and the text, tokenizer B (sentencepiece) the text, to which it adds
that space; special tokens are neither added nor looked for. Each token covers a range of the bytes of space + text.
The ranges of both sides are sorted by start; where a start reaches the running maximum of the ends, a group ends. So
groups are cut just where tokens of both sides end. Within a group, A and B tokens that overlap are paired; pairs that
end together are links.

An id pair's count is the number of links that hold it, over all documents. A link is a best one if no other A id has
a larger count with its B id.

A text is null, empty, or has tokens of one side that do not spell space + text: then it has no tokens, its numbers are 0
and its groups the empty text. Each row gives one row, null ids and repeated rows too; every row counts. An empty table gives
no rows. Other columns are not looked at.

Texts are encoded in units, cut at single spaces between visible characters of up to two bytes. No token of either side can
hold both such a character and a space after it (`Pair` looks through the vocabularies, and else does not cut), so the ids
are those of the whole text, and a worker needs to encode each unit once in a while. A long text has many units; one
without cuts is encoded whole.

Chunks of neighbouring rows are tokenized once and landed, with their distinct id pairs. Counts are summed by pair, with
partial sums before the shuffle, and go back to the chunks by join.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import tally
from flowlens.llm.common import frozen, land, land_by, lean, partition_id, pieces, ship, thawed
from flowlens.llm.memo import Encoded, Memo
from flowlens.llm.words import Words

CHUNK_BYTES = 4 << 20
# Bytes of text whose tokens are aligned at once; a longer text is a step of its own.
STEP_BYTES = 1 << 20
# Units that a worker remembers, about 40 bytes each, twice.
CAPACITY = 1 << 19
CHUNK = "chunk long, blob binary, which binary, pair array<long>, links array<long>"
# A space is a cut between characters of one or two bytes that are no white space.
_VISIBLE, _LEAD = np.zeros(256, bool), np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_LEAD[0xC3:0xE0] = True
_PAIRS: dict[tuple[str, str], Pair] = {}


def pair_of(path_a: str, path_b: str) -> Pair:
    """One for each worker and two vocabularies."""
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


class Pair:
    """Two tokenizers with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        known = _byte_of()
        bytes_a: list[bytes] = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            bytes_a[i] = bytes(known[c] for c in token) if all(c in known for c in token) else token.encode()
        bytes_b = [_piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        # A unit may start at a space behind a visible character if no token holds such two.
        self.cuts = not any(re.search(r"\S ", t.decode("utf-8", "replace")) for t in (*bytes_a, *bytes_b))
        self.bytes = bytes_a, bytes_b
        self.lengths = [np.array([len(t) for t in side], np.int64) for side in self.bytes]
        # Each id as decimal digits, filled up with zero bytes.
        numbers = np.char.encode(np.arange(max(map(len, self.bytes))).astype(str))
        self.digits = numbers.view(np.uint8).reshape(len(numbers), -1)
        self.memo = Memo(self._encode, 2, CAPACITY)

    def _encode(self, units: list[bytes]) -> Encoded:
        texts = [u.decode() for u in units]
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        sides, spelled = [], np.ones(len(units), bool)
        wanted = np.array([len(u) + 1 for u in units])
        whole = b" " + b" ".join(units)
        for ids, known, lengths in zip((a, self.b.encode(texts, num_threads=1)), self.bytes, self.lengths, strict=True):
            flat, counts = list(chain.from_iterable(ids)), np.fromiter(map(len, ids), np.int64, len(ids))
            numbers = np.array(flat, np.int64)
            stop = np.concatenate([[0], np.cumsum(lengths[numbers])])[np.cumsum(counts)]
            if not ((np.diff(stop, prepend=0) == wanted).all() and b"".join(map(known.__getitem__, flat)) == whole):
                spelled &= [b"".join(map(known.__getitem__, i)) == b" " + u for i, u in zip(ids, units, strict=True)]
            sides.append((numbers, counts))
        return sides, spelled

    def units(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        """What lies between the cuts of each text."""
        cut = np.zeros(len(data), bool)
        if self.cuts and len(data) > 2:
            cut[1:-1] = (data[1:-1] == 0x20) & (_VISIBLE[data[2:]] | _LEAD[data[2:]])
            at = np.flatnonzero(cut)
            before = data[at - 1]
            two = (before >= 0x80) & (at >= 2) & _LEAD[data[at - 2]]
            cut[at[~(_VISIBLE[before] | two)]] = False
            # Neighbours within the text.
            cut[np.minimum(offsets[:-1], len(data) - 1)] = False
            cut[np.maximum(offsets[1:] - 1, 0)] = False
        at, full = np.flatnonzero(cut), np.flatnonzero(np.diff(offsets))
        start = np.sort(np.concatenate([offsets[full], at + 1]))
        end = np.sort(np.concatenate([offsets[full + 1], at]))
        return Words(data, start, end, np.searchsorted(offsets, start, "right") - 1, len(offsets) - 1)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides, text after text, and how many each text has; none where a side does not spell the text."""
        units = self.units(data, offsets)
        distinct, first, which = np.unique(units.hashes(), return_index=True, return_inverse=True)
        place = self.memo.places(distinct, lambda some: units.values(first[some]))[which]
        wrong = self.memo.flags(place) == 0
        bad = np.zeros(units.n_docs, bool)
        bad[units.doc[wrong]] = True
        kept = ~bad[units.doc]
        place, doc = place[kept], units.doc[kept]
        ids, counts = [], []
        for side in (0, 1):
            flat, count = self.memo.gather(place, side)
            ids.append(flat.astype(np.int64))
            counts.append(np.bincount(doc, weights=count, minlength=units.n_docs).astype(np.int64))
        return ids, counts


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: visible ones for themselves, others in turn from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + n): b for n, b in enumerate(others)}


def _piece(piece: str) -> bytes:
    found = re.fullmatch("<0x([0-9A-F]{2})>", piece)
    return bytes([int(found[1], 16)]) if found else piece.replace("\u2581", " ").encode()


def coalesced(start: np.ndarray, end: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in order of start, and the group of each; ranges are not empty."""
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.zeros(len(order), bool)
    breaks[1:] = start[order][1:] >= reach[:-1]
    return order, np.cumsum(breaks)


def overlaps(start_a, end_a, start_b, end_b) -> tuple[np.ndarray, np.ndarray]:
    """Places of A and B tokens whose ranges overlap; a side's ranges ascend and do not overlap."""
    low, high = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    count = np.maximum(high - low, 0)
    stop = np.cumsum(count)
    total = int(stop[-1]) if len(stop) else 0
    return np.repeat(np.arange(len(count)), count), np.arange(total) + np.repeat(low - (stop - count), count)


class Aligned:
    """Tokens of some texts, one after another on one line of bytes."""

    def __init__(self, pair: Pair, data: np.ndarray, offsets: np.ndarray):
        self.ids, self.n = pair.encode(data, offsets)
        self.digits = pair.digits
        docs, n_a = len(offsets) - 1, len(self.ids[0])
        length = [pair.lengths[k][self.ids[k]] for k in (0, 1)]
        end = [np.cumsum(x) for x in length]
        start = [e - x for e, x in zip(end, length, strict=True)]
        side = np.repeat(np.array([0, 1], np.int8), [len(x) for x in self.ids])
        order, group = coalesced(np.concatenate(start), np.concatenate(end), side)
        i, j = overlaps(start[0], end[0], start[1], end[1])
        linked = end[0][i] == end[1][j]
        i, j = i[linked], j[linked]
        self.pairs = self.ids[1][j] << 32 | self.ids[0][i]
        doc_a = np.repeat(np.arange(docs), self.n[0])
        self.links = np.bincount(doc_a[i], minlength=docs)
        # Within a group, A's tokens come before B's: a token's place counts the other side's tokens of groups before.
        of = np.empty(len(order), np.int64)
        of[order] = group
        n_groups = int(group[-1]) + 1 if len(group) else 0
        before = [np.cumsum(np.bincount(g, minlength=n_groups)) for g in (of[:n_a], of[n_a:])]
        size_b = np.diff(before[1], prepend=0)
        place_a = np.arange(n_a) + (before[1] - size_b)[of[:n_a]]
        place_b = np.arange(len(of) - n_a) + before[0][of[n_a:]]
        self.id, self.mark = np.empty(len(of), np.int64), np.full(len(of), ord(","), np.uint8)
        self.id[place_a], self.id[place_b] = self.ids[0], self.ids[1]
        if n_groups:
            last_a, last_b = before[0] - 1, before[1] - 1
            self.mark[place_a[last_a]] = ord("|")
            self.mark[place_b[last_b]] = ord(";")
        first_a = np.flatnonzero(np.diff(of[:n_a], prepend=-1))
        self.groups = np.bincount(doc_a[first_a], minlength=docs)

    def texts(self) -> list[bytes]:
        """The groups of each text, as `a1,a2|b1;a3|b2,b3`."""
        table, width = self.digits, self.digits.shape[1]
        length = np.count_nonzero(table, axis=1)[self.id]
        stop = np.cumsum(length + 1)
        out = np.empty(int(stop[-1]) if len(stop) else 0, np.uint8)
        first = stop - length - 1
        for d in range(width):
            has = length > d
            out[first[has] + d] = table[self.id[has], d]
        out[stop - 1] = self.mark
        ends = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(self.n[0] + self.n[1])])]
        raw = out.tobytes()
        return [raw[a : max(a, b - 1)] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]


def _chunks(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool) -> DataFrame:
    """CHUNK: a blob has the numbers of its rows, `which` names the pair of each link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from flowlens.llm.words import texts

        pair, number = pair_of(path_a, path_b), partition_id() << 20
        for batch in batches:
            data, offsets = texts(batch.column(1))
            for lo, hi in pieces(offsets, CHUNK_BYTES):
                yield _chunk(pair, number, batch.column(0).slice(lo, hi - lo), data, offsets[lo : hi + 1], keep_groups)
                number += 1

    return docs.mapInArrow(lean(run), CHUNK)


def _chunk(pair: Pair, number: int, names: pa.Array, data: np.ndarray, offsets: np.ndarray, keep_groups: bool) -> pa.RecordBatch:
    """A row of CHUNK, aligned in steps."""
    none = np.zeros(0, np.int64)
    columns: dict[str, list[np.ndarray]] = {c: [none] for c in ("n_a", "n_b", "n_groups", "n_links")}
    pairs, hashes, groups = [none], [], []
    for lo, hi in pieces(offsets, STEP_BYTES):
        found = Aligned(pair, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        for c, x in zip(columns.values(), (*found.n, found.groups, found.links), strict=True):
            c.append(x)
        pairs.append(found.pairs)
        for g in found.texts():
            hashes.append(hashlib.sha256(g).hexdigest() if g else "")
            groups.append(g.decode() if keep_groups else None)
    known, which, links = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
    rows = pa.record_batch(
        {"doc_id": names}
        | {c: pa.array(np.concatenate(x), pa.int64()) for c, x in columns.items()}
        | {"groups_sha256": pa.array(hashes, pa.string()), "groups": pa.array(groups, pa.string())}
    )
    return pa.record_batch(
        {
            "chunk": pa.array([number], pa.int64()),
            "blob": pa.array([frozen(rows)], pa.binary()),
            "which": pa.array([tally.squeeze(which)], pa.binary()),
            "pair": pa.array([known], pa.list_(pa.int64())),
            "links": pa.array([links], pa.list_(pa.int64())),
        }
    )


def _counted(chunks: DataFrame) -> DataFrame:
    """pair, count, best of all chunks."""
    each = chunks.select(F.explode(F.arrays_zip("pair", "links")).alias("x"))
    counts = each.groupBy(F.col("x.pair").alias("pair")).agg(F.sum("x.links").alias("count"))
    counts = land(counts.withColumn("b", F.shiftright("pair", 32)), "pairs")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


OUT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
)


def _landed(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, keep_groups: bool) -> DataFrame:
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return land_by(_chunks(rows, path_a, path_b, keep_groups), "aligned", "chunk")


def id_pairs(docs: DataFrame, path_a: str, path_b: str, id_col="doc_id", text_col="text") -> DataFrame:
    """a_id, b_id, count, best: the id pairs that links hold."""
    found = _counted(_landed(docs, path_a, path_b, id_col, text_col, False))
    return found.select(F.col("pair").bitwiseAND(0xFFFFFFFF).alias("a_id"), F.shiftright("pair", 32).alias("b_id"), "count", "best")


def align(docs: DataFrame, path_a: str, path_b: str, id_col="doc_id", text_col="text", keep_groups: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups (null if not kept)."""
    chunks = _landed(docs, path_a, path_b, id_col, text_col, keep_groups)
    asked = chunks.select("chunk", F.explode("pair").alias("pair"))
    replies = asked.join(_counted(chunks), "pair").groupBy("chunk").agg(F.collect_list(F.struct("pair", "count", "best")).alias("reply"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                table = thawed(row.column(0)[0].as_py())
                reply = row.column(2).flatten()
                pair, count, best = (reply.field(c).to_numpy(zero_copy_only=False) for c in range(3))
                order = np.argsort(pair, kind="stable")
                which = tally.unsqueeze(row.column(1)[0].as_py()).astype(np.int64)
                counts, best = count[order][which], best[order][which].astype(np.int64)
                stop = np.cumsum(table.column("n_links").to_numpy())
                sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], stop])]) for x in (best, counts)]
                names = ["n_best", "count_sum"]
                columns = {c: table.column(c).combine_chunks() for c in table.column_names}
                columns |= {c: pa.array(x.astype(np.int64)) for c, x in zip(names, sums, strict=True)}
                yield pa.record_batch([columns[c.split()[0]] for c in OUT.split(", ")], [c.split()[0] for c in OUT.split(", ")])

    return chunks.join(replies, "chunk", "left").select("blob", "which", "reply").mapInArrow(lean(finish), OUT)
