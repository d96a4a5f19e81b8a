"""Counts of 64-bit keys over all chunks, sent back to each chunk.

Each chunk asks for its distinct keys, ascending, cut into buckets by their leading bits; a bucket adds
up what all chunks hold of it and answers each with the totals in its own order. Keys travel packed in
numpy arrays (differences of sorted keys, by byte planes), some bytes each instead of a row each.
A key held by every document is one entry of each chunk, so there are no hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from flowlens.llm.common import lean, lean_group

REQUEST = "chunk long, bucket long, keys binary, adds binary, more binary"
ANSWER = "chunk long, bucket long, totals binary, n_keys long, n_total long"
# Keys a bucket should hold, about.
BUCKET_KEYS = 1 << 20
NONE = ~np.uint64(0)


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned numbers by byte planes; leading zero planes are left out."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : blob[0]] = planes.T
    return out.view("<u8").reshape(-1)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unsqueeze_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(blob), dtype=np.uint64)


def bucket_bits(keys: int, each: int = BUCKET_KEYS) -> int:
    """Leading bits to cut by, so that a bucket holds `each` keys about."""
    return max(0, (max(1, keys) // each).bit_length())


def requests(
    chunk: int, keys: np.ndarray, adds: np.ndarray, bits: int, cut: int, most: np.ndarray | None = None
) -> Iterator[pa.RecordBatch]:
    """Rows of REQUEST. keys: distinct, ascending, of so many bits; cut: leading bits that name the bucket.

    adds: a number to be summed up, or the least of the chunk's values, with the largest as `most`.
    """
    bucket = (keys >> np.uint64(bits - cut)).astype(np.int64)
    names, first = np.unique(bucket, return_index=True)
    ends = np.append(first, len(keys))[1:]
    if len(names):
        spans = list(zip(first.tolist(), ends.tolist(), strict=True))
        yield pa.record_batch(
            {
                "chunk": pa.array([chunk] * len(names), pa.int64()),
                "bucket": pa.array(names, pa.int64()),
                "keys": pa.array([squeeze_sorted(keys[a:b]) for a, b in spans], pa.binary()),
                "adds": pa.array([squeeze(adds[a:b]) for a, b in spans], pa.binary()),
                "more": pa.array([most is not None and squeeze((most - adds)[a:b]) or None for a, b in spans], pa.binary()),
            }
        )


def answers(asked: DataFrame, least: bool = False) -> DataFrame:
    """Rows of ANSWER: the sum of all adds of a key, aligned with the request's keys.

    n_keys and n_total: the bucket's keys with a sum above 0, and all sums, in one row of the bucket, else 0.
    least: the least value of the key over all chunks, or NONE if that is its only value.
    """

    def add_up(rows: pa.Table) -> pa.Table:
        keys = [unsqueeze_sorted(b) for b in rows.column("keys").to_pylist()]
        adds = [unsqueeze(b) for b in rows.column("adds").to_pylist()]
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        starts = np.flatnonzero(np.diff(flat[order], prepend=~flat[order[:1]]))
        value = np.concatenate(adds)[order]
        if least:
            total = np.minimum.reduceat(value, starts)
            more = np.concatenate([unsqueeze(b) for b in rows.column("more").to_pylist()])[order]
            total[np.maximum.reduceat(value + more, starts) == total] = NONE
        else:
            total = np.add.reduceat(value, starts)
        totals = np.empty(len(flat), np.uint64)
        totals[order] = np.repeat(total, np.diff(np.append(starts, len(flat))))
        ends = np.cumsum([len(k) for k in keys])
        once = np.zeros((2, len(keys)), np.int64)
        if not least:
            once[:, 0] = np.count_nonzero(total), total.sum()
        return pa.table(
            {
                "chunk": rows.column("chunk"),
                "bucket": rows.column("bucket"),
                "totals": pa.array([squeeze(t) for t in np.split(totals, ends[:-1])], pa.binary()),
                "n_keys": pa.array(once[0]),
                "n_total": pa.array(once[1]),
            }
        )

    return asked.groupBy("bucket").applyInArrow(lean_group(add_up), ANSWER)


def answered(packed: DataFrame, replies: list[DataFrame], work, schema: str) -> DataFrame:
    """work(chunk, blob, *totals) yields record batches for each chunk; totals in the order of its keys.

    Only the replies move: the chunks lie bucketed.
    """
    from pyspark.sql import functions as F

    names = []
    for k, reply in enumerate(replies):
        names.append(f"reply{k}")
        packed = packed.join(
            reply.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "totals")).alias(f"reply{k}")), "chunk", "left"
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                totals = []
                for name in names:
                    parts = sorted(row[name] or [], key=lambda r: r["bucket"])
                    parts = [unsqueeze(p["totals"]) for p in parts]
                    totals.append(np.concatenate(parts) if parts else np.zeros(0, np.uint64))
                yield from work(row["chunk"], row["blob"], *totals)

    return packed.select("chunk", "blob", *names).mapInArrow(lean(run), schema)
