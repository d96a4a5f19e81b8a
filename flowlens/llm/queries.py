"""Registered queries of this subpackage: each operator over its whole table, and SQL where it can check it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import (
    alignment,
    best_fit,
    context_mixing,
    icws,
    mih,
    pivotal,
    presence_masks,
    rans,
    secret_scan,
    suffix_dedup,
    tput,
    url_trie,
    zstd_langid,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


@_query("op1_rans_tokens")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rans.round_trip(docs, vocabulary(), end_id=2).drop("ids")


URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


@_query(
    "op2_url_trie",
    r"""
WITH parts AS (
  SELECT page_id,
    translate(CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://([^/?#]*)', 1, 's') ELSE '' END,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path
  FROM pages),
clean AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path FROM parts),
rules(verdict, rule_host, rule_path) AS (VALUES
  ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, verdict, length(rule_host || rule_path) AS n
  FROM clean LEFT JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC) AS k FROM fits) WHERE k = 1
""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_trie.judge(pages, rules)


@_query("op7_pivotal_mix")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pivotal.mix(docs, weights=(5.0, 2.0, 1.0), cap=3.0)


@_query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return best_fit.pack(docs, vocabulary(), size=4096, end_id=1).drop("ids")


@_query("op10_icws_near_duplicates")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return icws.near_duplicates(docs)


@_query(
    "op6_suffix_automaton_dedup",
    r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13),
windows AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 12], ' ')) AS h FROM starts),
least AS (SELECT h, min(doc_id) AS first_doc FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM windows JOIN least USING (h) WHERE first_doc < doc_id),
gone_lists AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, k: js IS NULL OR NOT list_contains(js, k)), ' ')) AS kept_sha256
FROM words LEFT JOIN gone_lists USING (doc_id)
""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup.removed_words(docs, size=13).drop("text")


@_query("op5_zstd_language")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return zstd_langid.identify(docs)


@_query(
    "op3_tput_top_k",
    """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM scores) WHERE k <= 5
""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return tput.top_k(vecs, lambda vec_id: vec_id % 50 == 0, k=5, scale=256)


@_query("op8_multi_index_hashing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return mih.search(vecs, lambda vec_id: vec_id % 100 == 0, k=10)


@_query("op4_context_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return context_mixing.scores(docs)


@_query("op11_interval_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = alignment.align(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), keep_groups=False)
    return found.drop("groups")


SECRET_RULES = [*secret_scan.BASE, *secret_scan.MORE]
BASE_KINDS = [r.kind for r in secret_scan.BASE]


def _secret_sql() -> str:
    """Matches and what lies between them, of each rule; places are sums of lengths."""
    cased = {"(?i:password|passwd|secret|token|api_?key)": "|".join(
        "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
        for word in ("password", "passwd", "secret", "token", "api_?key")
    )}
    each = []
    for k, (kind, head, body, least) in enumerate(SECRET_RULES):
        for written, plain in cased.items():
            head = head.replace(written, f"(?:{plain})")
        head, body = (x.replace("'", "''") for x in (head, body))
        each.append(
            f"SELECT doc_id, {k} AS k, '{kind}' AS kind, {least} AS least, regexp_split_to_array(text, '{head}{body}') AS gaps, "
            f"regexp_extract_all(text, '{head}{body}') AS hits, regexp_extract_all(text, '{head}({body})', 1) AS bodies "
            f"FROM docs WHERE regexp_matches(text, '{head}{body}')"
        )
    base = ", ".join(f"'{k}'" for k in BASE_KINDS)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    zeros = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE_KINDS)
    joined = "string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k)"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({' UNION ALL '.join(each)}),
spans AS (
  SELECT doc_id, k, kind, least, strlen(bodies[i]) AS body, length(hits[i]) AS n,
    CAST(list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM found)),
kept AS (
  SELECT doc_id, {counts}, {joined} FILTER (kind IN ({base})) AS base, {joined} AS spans FROM spans WHERE body >= least GROUP BY doc_id)
SELECT doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN kept USING (doc_id)
"""


@_query("op12_secret_automaton", _secret_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = secret_scan.scan(docs, SECRET_RULES)
    return found.select(
        "doc_id",
        *[secret_scan.counted("spans", kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(secret_scan.joined("spans", BASE_KINDS), 256).alias("base_sha256"),
        secret_scan.joined("spans").alias("spans"),
    )


@_query(
    "op13_presence_masks",
    r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
lengths AS (SELECT doc_id, len(t) AS n FROM texts WHERE len(t) > 0),
totals AS (SELECT count(*) AS c, CAST(sum(n) AS BIGINT) AS l FROM lengths),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM texts) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * c + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term, c),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
wanted AS (SELECT item_id, term, count(*) AS q FROM asked GROUP BY ALL),
parts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * c) // l)))) AS part
  FROM tfs JOIN weights USING (term) JOIN lengths USING (doc_id), totals WHERE term IN (SELECT term FROM wanted)),
scores AS (SELECT item_id, doc_id, CAST(sum(q * part) AS BIGINT) AS score FROM wanted JOIN parts USING (term) GROUP BY ALL)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM scores WHERE score > 0) WHERE k <= 20
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return presence_masks.search(docs, items, k=20)
