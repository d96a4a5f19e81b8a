"""Ranking by masks against plain scores of all documents."""

import math
import random
import re
from collections import Counter

import pyarrow.parquet as pq

from flowlens.llm import presence_masks

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, total = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, found = Counter(terms(text)), []
        for i, have, n in held:
            m = 100 - 25 + 25 * n * n_docs // total if total else 0
            score = 0
            for t, q in asked.items():
                if have[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += q * w * (10**9 * have[t] // (1000 * have[t] + 12 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        found.sort(key=lambda f: f[:3])
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def ours(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_documents(spark, sf_dir):
    docs, items = (pq.read_table(f"{sf_dir}/{n}.parquet").to_pylist() for n in ("documents", "benchmark"))
    want = brute([(d["doc_id"], d["text"]) for d in docs], [(i["item_id"], i["text"]) for i in items])
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert ours(presence_masks.search(rows, asked)) == want
    # Items in several blocks.
    assert ours(presence_masks.search(rows, asked, block_bytes=2000)) == want


def test_ties_masks_of_many_terms_and_copies(spark):
    random.seed(2)
    pool = [f"t{i}" for i in range(160)] + ["É", "ß", "東京"]
    docs = [(random.randrange(400), " ".join(random.choices(pool, k=random.randint(0, 90)))) for _ in range(300)]
    docs += [(i, docs[7][1]) for i in range(1000, 1040)] + [(None, docs[7][1]), (5, None), (6, ""), (7, "--")]
    items = [(1, " ".join(pool)), (2, "T1 t2, t2;T3"), (3, "zzz"), (4, None), (5, ""), (6, docs[7][1]), (None, "t9 É")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame([*items, items[1]], "item_id long, text string")
    assert ours(presence_masks.search(rows, asked, k=25)) == brute(docs, items, 25)


def test_odd_tables(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    items = [(1, "the quick brown fox"), (2, "w5 w6 w7 TAIL"), (3, "é" * 5000)]
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id long")
    assert ours(presence_masks.search(odd_docs, asked)) == brute(docs, items)
    assert presence_masks.search(no_docs, asked).count() == 0
    assert presence_masks.search(odd_docs, asked.limit(0)).count() == 0


def test_groups_below_the_threshold_are_not_scored():
    """Many documents with one poor mask are left out once k better ones are known."""
    import numpy as np
    import pyarrow as pa

    items = presence_masks.Items([(1, "rare common other")])
    texts = ["common x"] * 3000 + ["rare common"] * 90
    names = pa.array(np.arange(len(texts)))
    batch = presence_masks._chunk(names, presence_masks.terms_of(pa.array(texts)), items)
    weights = np.zeros(len(items), np.int64)
    for term, df in zip(batch["term"][0].as_py(), batch["df"][0].as_py()):
        weights[term] = presence_masks.weight(len(texts), df)
    ranking = presence_masks.Ranking(items, weights, len(texts), 2 * len(texts), 20)
    ranking.take(batch["blob"][0].as_py())
    assert ranking.scored == 90
    assert ranking.best[0][0].tolist() == list(range(3000, 3020))
