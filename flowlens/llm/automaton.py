"""Suffix automata over words, as arrays that travel between tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from flowlens.llm.common import frozen, thawed


class Automaton:
    """Recognizes all word sequences within a shard's passages.

    A state holds its longest sequence's length, its suffix link, and the least document in which its
    sequences occur. Passages are kept apart by symbols of their own, which no text has.
    """

    def __init__(self, words: dict[bytes, int], steps: dict[int, int], length: list, link: list, doc: list):
        self.words, self.steps, self.length, self.link, self.doc = words, steps, length, link, doc

    @classmethod
    def build(cls, passages: list[tuple[int, bytes]]) -> Automaton:
        """passages: (document, words joined by white space)."""
        words: dict[bytes, int] = {}
        follow: list[dict[int, int]] = [{}]
        length, link, doc = [0], [-1], [None]
        last, apart = 0, -1
        for owner, text in passages:
            symbols = [words.setdefault(w, len(words)) for w in text.split()]
            symbols.append(apart)
            apart -= 1
            for c in symbols:
                new = len(length)
                follow.append({})
                length.append(length[last] + 1)
                link.append(0)
                doc.append(owner)
                p = last
                while p >= 0 and c not in follow[p]:
                    follow[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = follow[p][c]
                    if length[p] + 1 == length[q]:
                        link[new] = q
                    else:
                        clone = len(length)
                        follow.append(follow[q].copy())
                        length.append(length[p] + 1)
                        link.append(link[q])
                        doc.append(doc[q])
                        while p >= 0 and follow[p].get(c) == q:
                            follow[p][c] = clone
                            p = link[p]
                        link[q] = link[new] = clone
                last = new
        for state in np.argsort(-np.array(length), kind="stable").tolist():
            up = link[state]
            if up > 0 and doc[state] < doc[up]:
                doc[up] = doc[state]
        steps = {}
        for state, out in enumerate(follow):
            for c, to in out.items():
                if c >= 0:
                    steps[state << 32 | c] = to
        doc[0] = 0
        return cls(words, steps, length, link, doc)

    def dump(self) -> bytes:
        steps = np.array(sorted(self.steps.items()), np.int64).reshape(-1, 2)
        columns = {
            "words": pa.array([list(self.words)], pa.list_(pa.binary())),
            "keys": pa.array([steps[:, 0]], pa.list_(pa.int64())),
            "to": pa.array([steps[:, 1].astype(np.int32)], pa.list_(pa.int32())),
            "length": pa.array([np.array(self.length, np.int32)], pa.list_(pa.int32())),
            "link": pa.array([np.array(self.link, np.int32)], pa.list_(pa.int32())),
            "doc": pa.array([np.array(self.doc, np.int64)], pa.list_(pa.int64())),
        }
        return frozen(pa.record_batch(columns))

    @classmethod
    def load(cls, blob: bytes) -> Automaton:
        table = thawed(blob)
        part = {n: table.column(n).combine_chunks().flatten() for n in table.column_names}
        words = {w: i for i, w in enumerate(part["words"].to_pylist())}
        steps = dict(zip(part["keys"].to_numpy().tolist(), part["to"].to_numpy().tolist(), strict=True))
        return cls(words, steps, *(part[n].to_numpy().tolist() for n in ("length", "link", "doc")))

    def windows(self, text: list[bytes], owner: int, size: int) -> list[int]:
        """Starts of windows of so many words that also occur in a smaller document.

        The matching statistic at a word, the longest match that ends there, is followed up to `size`.
        """
        steps, length, link, doc = self.steps, self.length, self.link, self.doc
        state = matched = 0
        out = []
        for i, c in enumerate([self.words.get(w, -1) for w in text]):
            if c < 0:
                state = matched = 0
                continue
            to = steps.get(state << 32 | c)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = steps.get(state << 32 | c)
            if to is None:
                continue
            state = to
            matched += 1
            if matched >= size:
                matched = size
                while length[link[state]] >= size:
                    state = link[state]
                if doc[state] < owner:
                    out.append(i - size + 1)
        return out
