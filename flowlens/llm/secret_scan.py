"""Secret scans by one combined deterministic automaton.

All rules become one minimal automaton (dfa.py) of their reversed expressions. One pass over the bytes of the texts,
from right to left, so finds every place where a match of some rule begins. From the first of them the rule's own
automaton takes the longest match, then the next one behind its end, and so on: the leftmost, longest, non-overlapping
matches of each rule. Matches of different rules may overlap.

A rule is (kind, head, body, least): it matches head and body; the match is kept if at least `least` bytes follow the
longest match of the head. A dropped match still hides what it overlaps. The base rules hold ASCII alone in what they
count, so there bytes are characters; letters in either case are A-Z and a-z. In runs of one class, at least 24 of
them (`{24,}`) match just where a run is 24 or longer, so the base rule `hex` has its least length in the expression.

Places are code points of the text, the end exclusive. A null or empty text has no spans. Each row gives one row, null
ids and repeated rows, too. A text of any length is scanned whole. An empty table gives no rows; no rules give empty
spans. Other columns are not looked at. The automata are broadcast; a bound on their states (dfa.MAX_STATES) is checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import lean, pieces, ship
from flowlens.llm.dfa import END, Automaton, Parser, backwards, compiled


class Rule(NamedTuple):
    kind: str
    head: str
    body: str
    least: int


BASE = [
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""",
        r"[A-Za-z0-9+/_.=-]+",
        6,
    ),
    Rule("access", "", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "", "[0-9a-f]{24,}", 24),
]
# Public formats: PEM blocks, prefixed tokens, web tokens, and passwords within URLs.
MORE = [
    Rule("pem", "", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 1),
    Rule("hub", "gh[oprsu]_", "[A-Za-z0-9]+", 36),
    Rule("chat", "xox[abprs]-", "[A-Za-z0-9-]+", 10),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]+", 16),
    Rule("login", r"[a-z]+://[A-Za-z0-9._%-]+:", r"[^\x20\x09-\x0D:/@]+@", 4),
]
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


class Scanner:
    def __init__(self, rules: list[Rule]):
        self.rules = rules
        trees = [Parser(r.head + r.body).parse() if not r.head else ("cat", [Parser(r.head).parse(), Parser(r.body).parse()]) for r in rules]
        self.starts: Automaton | None = compiled([backwards(t) for t in trees], anchored=False) if rules else None
        self.whole = [compiled([t], anchored=True) for t in trees]
        self.heads = [compiled([Parser(r.head).parse()], anchored=True) if r.head else None for r in rules]

    def find(self, data: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, of texts with an END behind each."""
        if self.starts is None:
            return []
        place, masks = self.starts.run(np.ascontiguousarray(data[::-1]))
        begin, masks = len(data) - 1 - place[::-1], masks[::-1]
        found, raw = [], data.tobytes() if len(begin) else b""
        for k, rule in enumerate(self.rules):
            starts, i = begin[(masks >> k) & 1 == 1], 0
            while i < len(starts):
                start = int(starts[i])
                end = self.whole[k].longest(raw, start)
                head = self.heads[k].longest(raw, start) if self.heads[k] else start
                if end - head >= rule.least:
                    found.append((start, k, end))
                i = int(np.searchsorted(starts, end))
        return sorted(found)


def scan(docs: DataFrame, rules: list[Rule], id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, spans: kind, start, end of each kept match, by start, then in the order of the rules."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(list(rules)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from flowlens.llm.words import texts

        scanner = shared.value
        for batch in batches:
            data, offsets = texts(batch.column(1))
            for lo, hi in pieces(offsets):
                part = np.insert(data[offsets[lo] : offsets[hi]], offsets[lo + 1 : hi + 1] - offsets[lo], END)
                edges = offsets[lo : hi + 1] - offsets[lo] + np.arange(hi - lo + 1)
                rows: list[list[dict]] = [[] for _ in range(hi - lo)]
                for doc, spans in _by_text(scanner.find(part), edges):
                    chars = np.cumsum((part[edges[doc] : edges[doc + 1]] & 0xC0) != 0x80) - 1
                    for start, k, end in spans:
                        a, b = chars[[start - edges[doc], end - edges[doc]]].tolist()
                        rows[doc].append({"kind": scanner.rules[k].kind, "start": a, "end": b})
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(rows, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), f"doc_id long, spans {SPANS}")


def _by_text(found: list[tuple[int, int, int]], edges: np.ndarray) -> Iterator[tuple[int, list]]:
    """Spans in order of their text."""
    docs = np.searchsorted(edges, [f[0] for f in found], "right") - 1
    for doc in np.unique(docs).tolist():
        a, b = np.searchsorted(docs, [doc, doc + 1])
        yield doc, found[a:b]


def joined(spans, kinds: list[str] | None = None):
    """Spans as kind:start:end, by commas; those of some kinds alone, if given."""
    kept = F.filter(spans, lambda s: s["kind"].isin(kinds)) if kinds else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
