"""Token files coded by a static range asymmetric numeral system (rANS).

A file set holds three Parquet datasets, so that any Hadoop file system keeps it and Spark commits it:

- `table`: id int, freq long. Frequencies over all documents, scaled to sum to a power of two.
- `blocks`: one row for each block of whole neighbouring documents, in ascending (doc_id, row) order.
  Ids are dealt to `lanes` interleaved coders. A checkpoint every CHECKPOINT_ROWS rows of lanes holds the
  coder states and the place in the payload, so all segments between checkpoints decode side by side.
  `crc` is the crc32 of the block's ids, which each decode compares.
- `parts`: part, start: the ids before each part, so `start` of a document needs no scan.

A coder state lies in [2**31, 2**63) and moves 32 bits at a time.

Nulls: a null text is empty and yields its end id; a null doc_id sorts first. Repeated ids and rows are
kept, in a stable order for one written file. An empty table gives files without blocks and no rows.
Other columns are not looked at. A document longer than a block makes a longer block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.llm.common import land, lean, partition_id, pieces, ship
from flowlens.session import scratch_dir

U64 = np.uint64
LANES = 512
CHECKPOINT_ROWS = 256
BLOCK_IDS = 1 << 18
PART_IDS = 1 << 24
LOW = U64(1 << 31)


# --- the coder ---


def scaled(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids, frequencies (each 1 at least) that sum to 2**bits, and bits."""
    ids = np.array(sorted(counts), np.int64)
    bits = max(18, int(len(ids)).bit_length() + 2)
    if not len(ids):
        return ids, ids, bits
    have = np.array([counts[i] for i in ids.tolist()], np.float64)
    freq = np.maximum(1, np.floor(have / have.sum() * (1 << bits))).astype(np.int64)
    over = int(freq.sum()) - (1 << bits)
    order = np.argsort(-freq, kind="stable")
    while over > 0:  # take from the largest, in proportion
        take = np.minimum(freq[order] // 8, over)
        take = np.minimum(take, np.maximum(0, over - (np.cumsum(take) - take)))
        freq[order] -= take
        over -= int(take.sum())
    freq[order[0]] -= over
    return ids, freq, bits


class Coder:
    def __init__(self, ids: np.ndarray, freq: np.ndarray, bits: int, lanes: int = LANES):
        self.bits, self.lanes = U64(bits), lanes
        self.ids = ids.astype(np.uint32)
        self.freq = freq.astype(U64)
        self.first = (np.cumsum(freq) - freq).astype(U64)
        self.symbol = np.repeat(np.arange(len(ids), dtype=np.uint32), freq)
        self.place = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
        self.place[ids] = np.arange(len(ids))

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Checkpoint states (segments, lanes), their places in the payload, the payload."""
        rows = -(-len(ids) // self.lanes)
        symbols = np.zeros(rows * self.lanes, np.uint32)
        symbols[: len(ids)] = self.place[ids]
        symbols = symbols.reshape(rows, self.lanes)
        state = np.full(self.lanes, LOW, U64)
        states, words = [], []
        shift, wide = U64(63) - self.bits, U64(32)
        for r in range(rows - 1, -1, -1):
            f = self.freq[symbols[r]]
            full = state >= (f << shift)
            words.append(state[full].astype(np.uint32))
            state = np.where(full, state >> wide, state)
            q = state // f
            state = (q << self.bits) + (state - q * f) + self.first[symbols[r]]
            if r % CHECKPOINT_ROWS == 0:
                states.append(state)
        words.reverse()
        before = np.concatenate([[0], np.cumsum([len(w) for w in words])])[:-1:CHECKPOINT_ROWS]
        return np.array(states[::-1], U64), before.astype(np.int64), np.concatenate(words)

    def decode(self, n: int, states: np.ndarray, before: np.ndarray, payload: np.ndarray) -> np.ndarray:
        rows = -(-n // self.lanes)
        out = np.empty((len(states), CHECKPOINT_ROWS, self.lanes), np.uint32)
        state, at = states.copy(), before.copy()
        payload = np.concatenate([payload, np.zeros(1, np.uint32)]).astype(U64)
        low, wide = (U64(1) << self.bits) - U64(1), U64(32)
        last = rows - (len(states) - 1) * CHECKPOINT_ROWS
        for r in range(min(rows, CHECKPOINT_ROWS)):
            live = len(states) if r < last else len(states) - 1
            x = state[:live]
            slot = x & low
            s = self.symbol[slot]
            out[:live, r] = s
            x = self.freq[s] * (x >> self.bits) + slot - self.first[s]
            need = x < LOW
            counts = np.cumsum(need, axis=1)
            place = at[:live, None] + counts - 1
            x = np.where(need, (x << wide) | payload[np.where(need, place, -1)], x)
            at[:live] += counts[:, -1]
            state[:live] = x
        return self.ids[out.reshape(-1)[:n]]


# --- tokens, landed once ---


def _squeeze(numbers: np.ndarray, coder: zstandard.ZstdCompressor) -> bytes:
    """Unsigned numbers by byte planes, two where that is enough, for intermediate tables."""
    kind = "<u2" if not len(numbers) or int(numbers.max()) < 1 << 16 else "<u4"
    planes = numbers.astype(kind).view(np.uint8).reshape(len(numbers), -1).T
    return kind[2:].encode() + coder.compress(planes.tobytes())


def _unsqueeze(blob: bytes, coder: zstandard.ZstdDecompressor) -> np.ndarray:
    width = blob[0] - 48
    raw = np.frombuffer(coder.decompress(memoryview(blob)[1:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(f"<u{width}").reshape(-1)


def tokenized(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """doc_id, row, n_tokens, ids of each document, and in the first row of a piece the counts of its ids."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from flowlens.llm.tokens import encoder
        from flowlens.llm.words import split, texts

        encode, row, coder = encoder(vocabulary), partition_id() << 40, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, offsets = texts(batch.column(1))
            for lo, hi in pieces(offsets):
                words = split(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                ids, counts = encode.encode(words, end_id)
                ends = np.cumsum(counts).tolist()
                seen = [_squeeze(np.bincount(ids), coder)] + [None] * (hi - lo - 1)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(0).slice(lo, hi - lo),
                        "row": pa.array(np.arange(row, row + hi - lo), pa.int64()),
                        "n_tokens": pa.array(counts, pa.int64()),
                        "ids": pa.array([_squeeze(ids[a:b], coder) for a, b in zip([0, *ends], ends, strict=False)], pa.binary()),
                        "counts": pa.array(seen, pa.binary()),
                    }
                )
                row += hi - lo

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return land(rows.mapInArrow(lean(run), "doc_id long, row long, n_tokens long, ids binary, counts binary"), "tokens", "uncompressed")


def _frequencies(tokens: DataFrame) -> dict[int, int]:
    """Counts of ids over all documents; as many rows as the vocabulary has ids, at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, coder = np.zeros(0, np.int64), zstandard.ZstdDecompressor()
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                part = _unsqueeze(blob, coder)
                if len(part) > len(total):
                    total = np.concatenate([total, np.zeros(len(part) - len(total), np.int64)])
                total[: len(part)] += part
        seen = np.flatnonzero(total)
        yield pa.record_batch({"id": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    counts = tokens.select("counts").where(F.col("counts").isNotNull()).mapInArrow(lean(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in counts.collect()}


# --- files ---

BLOCK_SCHEMA = (
    "part int, block int, start long, n long, n_docs int, docs binary, states binary, places binary, "
    "payload binary, crc long"
)


def write(
    docs: DataFrame, path: str, vocabulary: str, id_col="doc_id", text_col="text", end_id=2, part_ids: int = PART_IDS
) -> None:
    """Encode all documents into a file set below `path`."""
    spark = docs.sparkSession
    tokens = tokenized(docs, vocabulary, id_col, text_col, end_id)
    ids, freq, bits = scaled(_frequencies(tokens))
    table = list(zip(ids.tolist(), freq.tolist(), strict=True))
    spark.createDataFrame(table, "id int, freq long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast((ids, freq, bits))

    def block(part: int, number: int, start: int, names: list, counts: list[int], ids: list[np.ndarray], coder: Coder):
        flat = np.concatenate(ids)
        states, places, payload = coder.encode(flat)
        known = pa.record_batch({"doc_id": pa.array(names, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
        from flowlens.llm.common import frozen

        return pa.record_batch(
            {
                "part": pa.array([part], pa.int32()),
                "block": pa.array([number], pa.int32()),
                "start": pa.array([start], pa.int64()),
                "n": pa.array([len(flat)], pa.int64()),
                "n_docs": pa.array([len(names)], pa.int32()),
                "docs": pa.array([frozen(known)], pa.binary()),
                "states": pa.array([states.astype("<u8").tobytes()], pa.binary()),
                "places": pa.array([places.astype("<i8").tobytes()], pa.binary()),
                "payload": pa.array([payload.astype("<u4").tobytes()], pa.binary()),
                "crc": pa.array([zlib.crc32(flat.astype("<u4").tobytes())], pa.int64()),
            }
        )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, unpack = Coder(*shared.value), zstandard.ZstdDecompressor()
        part, number, start, held = partition_id(), 0, 0, 0
        names, counts, ids = [], [], []
        for batch in batches:
            for name, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names.append(name)
                counts.append(n)
                ids.append(_unsqueeze(blob, unpack).astype(np.uint32))
                held += n
                if held >= BLOCK_IDS:
                    yield block(part, number, start, names, counts, ids, coder)
                    number, start, held = number + 1, start + held, 0
                    names, counts, ids = [], [], []
        if names:
            yield block(part, number, start, names, counts, ids, coder)

    total = sum(_frequencies_total(tokens))
    parts = max(1, -(-total // part_ids))
    ordered = tokens.repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    blocks = ordered.select("doc_id", "n_tokens", "ids").mapInArrow(lean(encode), BLOCK_SCHEMA)
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    sizes = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start")).write.parquet(f"{path}/parts")


def _frequencies_total(tokens: DataFrame) -> list[int]:
    return [tokens.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0]


def read(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids (little-endian unsigned 32-bit; null if not kept)."""
    ship(spark)
    rows = spark.read.schema("id int, freq long").parquet(f"{path}/table").orderBy("id").collect()
    ids, freq = np.array([r["id"] for r in rows], np.int64), np.array([r["freq"] for r in rows], np.int64)
    shared = spark.sparkContext.broadcast((ids, freq, max(0, int(freq.sum()).bit_length() - 1)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from flowlens.llm.common import thawed

        coder = Coder(*shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                places = np.frombuffer(row["places"], "<i8")
                states = np.frombuffer(row["states"], "<u8").reshape(len(places), -1)
                coder.lanes = states.shape[1]
                flat = coder.decode(row["n"], states, places, np.frombuffer(row["payload"], "<u4"))
                raw = flat.astype("<u4").tobytes()
                if zlib.crc32(raw) != row["crc"]:
                    raise ValueError(f"block {row['block']} of part {row['part']} is damaged")
                known = thawed(row["docs"])
                counts = known.column("n_tokens").to_numpy()
                ends = np.cumsum(counts)
                spans = [raw[4 * a : 4 * b] for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch(
                    {
                        "part": pa.array([row["part"]] * len(counts), pa.int32()),
                        "doc_id": known.column("doc_id").combine_chunks(),
                        "start": pa.array(row["start"] + ends - counts, pa.int64()),
                        "n_tokens": pa.array(counts, pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(s) for s in spans], pa.int64()),
                        "ids": pa.array(spans if keep_ids else [None] * len(spans), pa.binary()),
                    }
                )

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    rows = blocks.mapInArrow(
        decode, "part int, doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    )
    parts = spark.read.schema("part int, part_start long").parquet(f"{path}/parts")
    return rows.join(parts, "part").select(
        "doc_id", (F.col("start") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32", "ids"
    )


def round_trip(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Write all documents to a new file set in the shared folder and read it back."""
    path = scratch_dir(docs.sparkSession, "rans")
    write(docs, path, vocabulary, **options)
    return read(docs.sparkSession, path)
