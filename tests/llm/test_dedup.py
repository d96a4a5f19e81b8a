"""Near-duplicates and repeated spans against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

from flowlens.llm import icws, suffix_dedup
from flowlens.llm.automaton import Automaton
from flowlens.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(text or "")
    if len(words) < 5:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def classes(texts, threshold=0.8):
    """Class of each row by all pairs that share a shingle."""
    sets = [shingles(t) for t in texts]
    df, n = Counter(s for c in sets for s in c), max(len(texts), 2)
    weight = {s: 1 + math.log(n / c) / (2 * math.log(n)) for s, c in df.items()}
    whole = [sum(f * weight[s] for s, f in c.items()) for c in sets]
    holders, common = defaultdict(list), Counter()
    for i, c in enumerate(sets):
        for s in c:
            for j in holders[s]:
                common[j, i] += min(c[s], sets[j][s]) * weight[s]
            holders[s].append(i)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, j), both in common.items():
        if both / (whole[i] + whole[j] - both) >= threshold - 1e-12:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))]


def partition(names, groups):
    out = defaultdict(list)
    for name, group in zip(names, groups, strict=True):
        out[group].append(name)
    return sorted(sorted(map(str, v)) for v in out.values())


def test_a_large_group_of_near_copies_takes_few_pairs(spark, monkeypatch):
    """About a pair a row, though copies share many buckets, each with a pivot of its own; and one class."""
    common = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*common[: i % 290], f"x{i}", *common[i % 290 :]])) for i in range(600)]
    made, compared = [], icws._compared
    monkeypatch.setattr(icws, "_compared", lambda pairs, *rest: made.append(pairs.count()) or compared(pairs, *rest))
    found = icws.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in found} == {0}
    assert sum(made) < 1.5 * len(rows)


def test_pivots_of_a_large_bucket_change_with_the_step(spark):
    """At first the least row; then several rows, other ones in each step, of which one is not of the least row's group."""
    rows = [(i, 0, 5, 0 if i % 10 else i, [i]) for i in range(200)] + [(7, 1, 6, 0, [7])]
    met = spark.createDataFrame(rows, "row long, band int, hash long, root long, bits array<long>").cache()
    of = {step: {(r["band"], r["pivot"], r["pivot_root"], tuple(r["pivot_bits"])) for r in icws._pivots(met, step).collect()} for step in (0, 1, 2, 3)}
    assert of[0] == of[1] == {(0, 0, 0, (0,)), (1, 7, 0, (7,))}
    for step in (2, 3):
        drawn = {p for band, p, _, _ in of[step] if band == 0}
        assert icws.DRAWS <= len(drawn) <= icws.DRAWS + 1 and any(p and p % 10 == 0 for p in drawn)
        assert of[step] <= {(band, row, root, tuple(bits)) for row, band, _, root, bits in rows}
    assert of[2] != of[3]


def test_classes_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    found = icws.near_duplicates(docs).collect()
    want = partition([r["doc_id"] for r in rows], classes([r["text"] for r in rows]))
    assert partition([r["doc_id"] for r in found], [r["class_id"] for r in found]) == want
    assert all(r["class_size"] == len(next(c for c in want if str(r["doc_id"]) in c)) for r in found[:50])
    assert sum(r["stays"] for r in found) == len(want)


def test_a_group_of_near_copies(spark):
    """Copies that differ from each other in other places: all links of other texts count."""
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(60):
        words = list(base)
        for j in range(i % 7):
            words[(i * 31 + j * 53) % 200] = f"x{i}_{j}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted(icws.near_duplicates(docs).collect(), key=lambda r: r["doc_id"])
    assert [r["class_id"] for r in found] == classes(texts)


def test_any_number_of_bands(spark, monkeypatch):
    """Pairs that share no early band, and open pairs without any pivot, are found with every number of bands."""
    texts = []
    for i in range(40):
        words = [f"v{i // 8}_{j}" for j in range(120)]
        words[(i * 37) % 120] = f"y{i}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = classes(texts)
    for bands, pivots, exact in ((8, 0, False), (20, 0, True), (20, 4, False)):
        monkeypatch.setattr(icws, "PIVOTS", pivots)
        found = sorted(icws.near_duplicates(docs, bands=bands, exact=exact).collect(), key=lambda r: r["doc_id"])
        assert [r["class_id"] for r in found] == want


def test_columns_named_as_within(spark):
    rows = [(1, "a b c d e f", 7, "x", "s"), (2, "a b c d e f", 8, "y", "t"), (3, None, 9, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id long, __text string, __row string")
    for stage in (icws.one_of_each, suffix_dedup.deduplicate):
        left = sorted(tuple(r) for r in stage(docs).collect())
        assert left[0] == rows[0] and left[-1] == rows[2]


def test_odd_rows(spark, odd_docs, no_docs):
    found = icws.near_duplicates(odd_docs).collect()
    rows = [r["class_id"] for r in found if r["doc_id"] in (1, 2)]
    assert rows == [1, 1, 1] and len(found) == odd_docs.count()
    assert [r["class_id"] for r in found if r["doc_id"] in (3, 4, 5)] and {6} == {r["class_id"] for r in found if r["doc_id"] in (6, 7)}
    alone = [r for r in found if r["doc_id"] in (3, 4, 5)]
    assert all(r["class_id"] == r["doc_id"] and r["stays"] for r in alone)
    left = icws.one_of_each(odd_docs)
    assert left.columns == odd_docs.columns and left.count() == sum(r["stays"] for r in found)
    assert icws.near_duplicates(no_docs).count() == 0 and icws.one_of_each(no_docs).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 1), (20, 21), (30, 30), (40, 39), (39, 41)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {**dict.fromkeys((1, 2, 3, 6, 7, 8, 9), 1), 20: 20, 21: 20, 39: 39, 40: 39, 41: 39}


def kept(docs, size):
    """n_words, n_removed, sha256 of each (doc_id, text), by comparing windows."""
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in docs]
    for i, words in split:
        if i is not None:
            for j in range(len(words) - size + 1):
                window = tuple(words[j : j + size])
                first[window] = min(first.get(window, i), i)
    out = Counter()
    for i, words in split:
        gone = {
            k for j in range(len(words) - size + 1) if i is not None and first[tuple(words[j : j + size])] < i
            for k in range(j, j + size)
        }
        left = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[i, len(words), len(gone), hashlib.sha256(left.encode()).hexdigest()] += 1
    return out


def test_spans_equal_brute_force(spark, sf_dir, odd_docs, no_docs):
    for docs, size in ((spark.read.parquet(f"{sf_dir}/documents.parquet"), 13), (odd_docs, 13), (odd_docs, 3)):
        rows = suffix_dedup.removed_words(docs, size=size).collect()
        found = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows)
        assert found == kept([tuple(r) for r in docs.select("doc_id", "text").collect()], size)
    assert suffix_dedup.removed_words(no_docs).count() == 0 and suffix_dedup.deduplicate(no_docs).count() == 0


def test_spans_leave_other_columns(spark, odd_docs):
    left = suffix_dedup.deduplicate(odd_docs)
    assert left.columns == odd_docs.columns
    ids = sorted(r["doc_id"] for r in left.where("doc_id IS NOT NULL").collect())
    assert ids == [1, 3, 4, 5, 6, 7, 8, 9, 10, 11], "rows of which nothing is left go"


def test_automaton_is_the_same_after_a_journey():
    import random

    rng = random.Random(4)
    passages = [(rng.randint(-9, 9), " ".join(rng.choice("abc") for _ in range(rng.randint(3, 30))).encode()) for _ in range(30)]
    held = Automaton.load(Automaton.build(passages).dump())
    for _ in range(100):
        words = [rng.choice("abcd").encode() for _ in range(20)]
        owner = rng.randint(-9, 9)
        windows = [
            i for i in range(17) if any(o < owner and b" ".join(words[i : i + 4]) in t for o, t in passages)
        ]
        assert held.windows(words, owner, 4) == windows
