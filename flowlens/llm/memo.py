"""Ids of short texts, remembered in a worker for as long as they are used.

Texts are known by their 64-bit hashes, in sorted arrays, some 30 bytes a text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

U64 = np.uint64
# (ids of all texts one after another, how many each text has) for each side, and a flag for each text.
Encoded = tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]
# Texts that one call encodes.
CALL = 1 << 14


class _Held:
    def __init__(self, sides: int):
        self.hash, self.place = np.zeros(0, U64), np.zeros(0, np.int32)
        self.ids = [np.zeros(0, np.uint16) for _ in range(sides)]
        self.ends = [np.zeros(1, np.int64) for _ in range(sides)]
        self.flags = np.zeros(0, np.uint8)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of texts, -1 if they are not held."""
        if not len(self.hash):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[at] == hashes, self.place[at], -1).astype(np.int64)

    def add(self, hashes: np.ndarray, sides: list, flags: np.ndarray) -> None:
        place = np.arange(len(self.flags), len(self.flags) + len(hashes), dtype=np.int32)
        known = np.concatenate([self.hash, hashes])
        order = np.argsort(known)
        self.hash, self.place = known[order], np.concatenate([self.place, place])[order]
        for k, (flat, counts) in enumerate(sides):
            self.ends[k] = np.concatenate([self.ends[k], np.cumsum(counts, dtype=np.int64) + self.ends[k][-1]])
            small = np.uint16 if not len(flat) or int(flat.max()) < 1 << 16 else np.uint32
            self.ids[k] = np.concatenate([self.ids[k], flat.astype(small)])
        self.flags = np.concatenate([self.flags, flags.astype(np.uint8)])

    def gather(self, place: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        begin = self.ends[side][place]
        count = self.ends[side][place + 1] - begin
        stop = np.cumsum(count)
        total = int(stop[-1]) if len(stop) else 0
        return self.ids[side][np.arange(total) + np.repeat(begin - (stop - count), count)], count


class Memo:
    """Two generations of about `capacity` texts each: when one is full, it takes the place of the one before, and texts
    that are asked for again move on; the rest is forgotten."""

    def __init__(self, encode: Callable[[list[bytes]], Encoded], sides: int, capacity: int):
        self.encode, self.sides, self.capacity = encode, sides, capacity
        self.now, self.before = _Held(sides), _Held(sides)

    def places(self, hashes: np.ndarray, spell: Callable[[np.ndarray], list[bytes]]) -> np.ndarray:
        """Where texts of distinct hashes are held, until the next call; `spell` gives the bytes of some of them."""
        if len(self.now.hash) > self.capacity:
            self.now, self.before = _Held(self.sides), self.now
        new = np.flatnonzero(self.now.find(hashes) < 0)
        place = self.before.find(hashes[new])
        moved, place = new[place >= 0], place[place >= 0]
        if len(moved):
            self.now.add(hashes[moved], [self.before.gather(place, k) for k in range(self.sides)], self.before.flags[place])
            new = np.flatnonzero(self.now.find(hashes) < 0)
        parts = [self.encode(spell(new[lo : lo + CALL])) for lo in range(0, len(new), CALL)]
        if parts:
            sides = [tuple(np.concatenate([p[0][k][x] for p in parts]) for x in (0, 1)) for k in range(self.sides)]
            self.now.add(hashes[new], sides, np.concatenate([p[1] for p in parts]))
        return self.now.find(hashes)

    def gather(self, place: np.ndarray, side: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts held there, one after another, and how many each has."""
        return self.now.gather(place, side)

    def flags(self, place: np.ndarray) -> np.ndarray:
        return self.now.flags[place]
