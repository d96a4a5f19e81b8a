"""URL filters: a trie over reversed host labels, then path segments; the longest rule wins.

The host is what stands after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; the path
goes on up to `?`, `#` or the end. A null URL, or one without `://`, has both empty. A rule fits its host
and all subdomains if the path starts with the rule's path. Of rules that fit, the one with more host
labels wins, then the one with the longer path; allow and block of the same rule: block.

The trie is broadcast while the rules' text stays below a bound. Beyond it, URLs meet the rules by an equi-join
on host suffix, which asks nothing of the number of rules.

Each input row gives one row, repeated rows and null ids too. Empty tables give no rows, no rules give
the default verdict. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import land, ship

# Bytes of rule text that a broadcast trie may hold.
MAX_BROADCAST = 8 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """Nodes are dicts: whole labels or segments to nodes. A node's rules hang at TAIL, by the start
    that the next, unfinished segment must have: first by its length, the longest first. A look-up so takes
    as many steps as rules have labels, segments and lengths, however long the URL is."""

    PATH, TAIL = 0, 1

    def __init__(self, rules: list[Rule]):
        self.root: dict = {}
        self.depth = max((path.count("/") for _, _, path in rules), default=0) + 1
        self.labels = max((host.count(".") for _, host, _ in rules), default=0) + 1
        # Longer starts first, so that each node's lengths descend.
        for verdict, host, path in sorted(rules, key=lambda r: -len(r[2].rsplit("/", 1)[-1])):
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(label, {})
            node = node.setdefault(self.PATH, {})
            *whole, tail = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            tails = node.setdefault(self.TAIL, {}).setdefault(len(tail), {})
            if tails.get(tail, ("", ""))[0] != "block":
                tails[tail] = (verdict, host + path)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        found, node = None, self.root
        for label in [None, *reversed(host.rsplit(".", self.labels))]:
            if label is not None:
                node = node.get(label)
                if node is None:
                    break
            if self.PATH in node:
                found = self._longest(node[self.PATH], path) or found
        return found

    def _longest(self, node: dict, path: str) -> tuple[str, str] | None:
        found, segments = None, path.split("/", self.depth)
        for i, segment in enumerate(segments):
            for n, tails in node.get(self.TAIL, {}).items():
                if segment[:n] in tails:
                    found = tails[segment[:n]]
                    break
            node = node.get(segment) if i + 1 < len(segments) else None
            if node is None:
                break
        return found


def judge(
    pages: DataFrame, rules: DataFrame, id_col="page_id", url_col="url", default="allow", max_broadcast=MAX_BROADCAST
) -> DataFrame:
    """page_id, host, path, rule, verdict. `rules` has verdict, host, path; nulls there are empty text."""
    clean = rules.select(
        F.lower("verdict").alias("verdict"),
        F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
    ).where(F.col("verdict").isin("allow", "block"))
    size = clean.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64).alias("n")).first()["n"] or 0
    urls = pages.select(
        F.col(id_col).alias("page_id"),
        host_of(F.col(url_col)).alias("host"),
        path_of(F.col(url_col)).alias("path"),
    )
    if size <= max_broadcast:
        return _by_trie(urls, clean, default)
    return _by_join(urls, clean, default)


def _by_trie(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    ship(urls.sparkSession)
    shared = urls.sparkSession.sparkContext.broadcast([tuple(r) for r in rules.collect()])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for batch in batches:
            found = [
                trie.find(h, p)
                for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            yield pa.record_batch(
                [
                    *batch.columns,
                    pa.array([f and f[1] for f in found], pa.string()),
                    pa.array([f[0] if f else default for f in found], pa.string()),
                ],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    kind = urls.schema["page_id"].dataType.simpleString()
    return urls.mapInArrow(find, f"page_id {kind}, host string, path string, rule string, verdict string")


def _by_join(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """Each distinct host and path once; its host suffixes and path starts, up to each slash, meet the rules."""
    urls = land(urls, "urls")
    # No more labels and segments than rules have.
    most = rules.agg(
        F.max(F.size(F.split("host", r"\.", -1))).alias("labels"), F.max(F.size(F.split("path", "/", -1))).alias("depth")
    ).first()
    labels = F.split(F.substring_index("host", ".", -(most["labels"] or 1)), r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(0), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels) - i), "."),
    )
    segments = F.split("path", "/", (most["depth"] or 1) + 1)
    starts = F.transform(
        F.sequence(F.lit(0), F.least(F.size(segments), F.lit(most["depth"] or 1)) - 1),
        lambda i: F.array_join(F.slice(segments, F.lit(1), i), "/"),
    )
    # Rules by host and the whole segments of their path; only the unfinished segment is compared by start.
    cut = F.regexp_extract("rule_path", r"(?s)^(.*/)?([^/]*)$", 1)
    known = rules.select(
        "verdict", F.col("host").alias("rule_host"), F.col("path").alias("rule_path")
    ).withColumn("rule_depth", F.size(F.split(cut, "/", -1))).withColumn(
        "rule_start", F.when(F.length(cut) > 0, F.expr("substring(rule_path, 1, length(rule_path) - length(substring_index(rule_path, '/', -1)) - 1)")).otherwise("")
    )
    once = urls.select("host", "path").distinct()
    asked = once.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("rule_host"), starts.alias("starts"))
    asked = asked.select("host", "path", "rule_host", F.posexplode("starts").alias("depth", "rule_start"))
    asked = asked.withColumn("rule_depth", F.col("depth") + 1)
    fits = asked.join(known, ["rule_host", "rule_start", "rule_depth"]).where(F.startswith("path", F.col("rule_path")))
    best = fits.groupBy("host", "path").agg(
        F.max(
            F.struct(
                F.when(F.col("rule_host") == "", 0).otherwise(F.size(F.split("rule_host", r"\.", -1))).alias("labels"),
                F.length("rule_path").alias("length"),
                F.col("verdict"),
                F.concat("rule_host", "rule_path").alias("rule"),
            )
        ).alias("best")
    )
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
