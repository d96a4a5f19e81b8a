"""Words of Arrow text columns as numpy arrays: places and 64-bit hashes, without a Python loop.

A word is a longest run of bytes other than 0x20 and 0x09 to 0x0D.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=U64)
# Odd multipliers of a common 64-bit finalizer.
_M1, _M2, _M3 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53), U64(0x9E3779B97F4A7C15)
# Longer words are hashed one by one.
LONG_WORD = 256


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its texts; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; no other byte changes."""
    return _LOWER[data]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(33))
    x = x * _M1
    x = x ^ (x >> U64(33))
    x = x * _M2
    return x ^ (x >> U64(33))


@dataclass
class Words:
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # index of the text
    n_docs: int

    def __len__(self) -> int:
        return len(self.start)

    def per_doc(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs).astype(np.int64)

    def hashes(self) -> np.ndarray:
        """Of each word; the same on every machine."""
        length = self.end - self.start
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        loads = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        h = mix(length.astype(U64) * _M3)
        short = length <= LONG_WORD
        live = np.flatnonzero(short)
        step = 0
        while len(live):
            left = length[live] - step
            value = loads[self.start[live] + step] & _KEEP[np.minimum(left, 8)]
            h[live] = mix((h[live] ^ value) * _M3)
            step += 8
            live = live[left > 8]
        for i in np.flatnonzero(~short):
            h[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.end[i]].tobytes())
        return h

    def values(self, which: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.start[which].tolist(), self.end[which].tolist(), strict=True)]


def split(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> Words:
    """Longest runs of bytes that are not `between` (a flag for each byte)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none, len(offsets) - 1)
    inside = ~between[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(data, start, end, doc, len(offsets) - 1)


def grams(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where so many words of one text begin, and the hash of those words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.flatnonzero(doc[size - 1 :] == doc[:n])
    total = np.zeros(n, U64)
    for j in range(size):
        total = total * _M1 + hashes[j : j + n]
    return at, mix(total[at])
