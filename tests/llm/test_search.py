"""Searches against all pairs."""

import numpy as np
import pytest

from flowlens.llm import mih, tput

ODD = [
    (0, [0.1, 0.2, 0.3]), (50, [0.1, 0.2, 0.3]), (100, [0.5, -0.5, 0.25]), (1, None), (2, [float("nan"), 1.0, 1.0]),
    (3, [None, 1.0, 2.0]), (4, [float("inf"), 0.0, 0.0]), (5, [0.0, 0.0, 0.0]), (6, [1.0]), (7, [0.1, 0.2, 0.3, 0.4]),
    (8, []), (9, [0.1, 0.2, 0.3]), (9, [0.1, 0.2, 0.3]), (None, [0.1, 0.2, 0.3]), (10, [-3.5, 2.0, 1e6]),
]
SCHEMA = "vec_id long, embedding array<double>, rank int, block int, score string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in ODD], SCHEMA)


def usable(rows):
    rows = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in rows), default=0)
    return sorted({(i, tuple(v) + (0.0,) * (width - len(v))) for i, v in rows})


def top(rows, step, k, scale):
    out = []
    for q, a in rows:
        if q % step == 0:
            scores = {(-int(sum(np.floor(scale * x) * np.floor(scale * y) for x, y in zip(a, b, strict=True))), v) for v, b in rows if v != q}
            out += [(q, n, v, -s) for n, (s, v) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("slices", [1, 2, 5])
def test_top_k_is_exact(spark, odd, slices):
    for table, step in ((odd, 50), (spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"), 50)):
        rows = usable([(r["vec_id"], r["embedding"]) for r in table.collect()])
        found = tput.top_k(table, lambda v: v % 50 == 0, k=5, slices=slices).collect()
        assert sorted(map(tuple, found)) == top(rows, step, 5, 256)


@pytest.mark.parametrize("times", [2, 9])
def test_repeated_rows_take_no_place_of_other_ids(spark, times):
    same, worse = [1.0, 2.0, 3.0], [0.5, 1.0, 1.5]
    rows = [(1, same)] * times + [(i, same) for i in range(2, 9)] + [(i, worse) for i in range(9, 15)]
    table = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA)
    found = tput.top_k(table, lambda v: v % 2 == 0, k=5).collect()
    assert sorted(map(tuple, found)) == top(usable(rows), 2, 5, 256)
    found = sorted(map(tuple, mih.search(table, lambda v: v % 2 == 0, k=5).collect()))
    assert [r[:3] for r in found] == [r[:3] for r in nearest(usable(rows), 2, 5)]


def test_scores_that_do_not_fit(spark):
    """Vectors beyond 64 bits take no part; those just below it are scored exactly."""
    big, huge = 2.0**22 / 2, 1e300
    rows = [(0, [big, -big]), (50, [1e6, 3.0]), (1, [big, big]), (2, [huge, 1.0]), (100, [huge, -huge]), (3, [big, 0.25])]
    table = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA)
    found = tput.top_k(table, lambda v: v % 50 == 0, k=5).collect()
    assert sorted(map(tuple, found)) == top(usable([r for r in rows if abs(r[1][0]) < huge]), 50, 5, 256)


def test_top_k_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tput.top_k(empty, lambda v: v % 50 == 0).count() == 0
    assert mih.search(empty, lambda v: v % 50 == 0).count() == 0


def nearest(rows, step, k):
    out = []
    for q, a in rows:
        if q % step == 0:
            far = sorted({(float(np.sqrt(((np.array(b) - np.array(a)) ** 2).sum())), v) for v, b in rows if v != q})
            out += [(q, n, v, s) for n, (s, v) in enumerate(far[:k], 1)]
    return sorted(out)


def test_nearest_of_odd_rows(spark, odd):
    rows = [(i, v) for i, v in usable(ODD) if any(v)]
    found = sorted(map(tuple, mih.search(odd, lambda v: v % 50 == 0, k=10).collect()))
    want = nearest(rows, 50, 10)
    assert [r[:3] for r in found] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in found], [r[3] for r in want], rtol=1e-12)


def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    ids = np.array([r["vec_id"] for r in table.collect()])
    x = np.array([r["embedding"] for r in table.collect()])
    found = mih.search(table, lambda v: v % 100 == 0, k=10).collect()
    hits = 0
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        far[ids == q] = np.inf
        mine = [r for r in found if r["query_id"] == q]
        assert sorted(r["rank"] for r in mine) == list(range(1, 11))
        assert all(abs(r["score"] - far[ids == r["vec_id"]][0]) < 1e-12 for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(ids[np.lexsort((ids, far))[:10]]))
    assert hits / len(found) >= 0.9


def test_probing_retrieves_all_within_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 16, (500, 4)).astype("<u2")
    codes[:100] = codes[0] ^ (1 << rng.integers(0, 16, (100, 4))).astype("<u2")
    postings = np.argsort(codes, axis=0, kind="stable").T
    apart = mih._ONES[codes ^ codes[0]].sum(axis=1)
    for radius in (0, 1, 3, 7, 20, 64):
        assert sorted(mih.retrieved(codes[0], codes, postings, radius)) == np.flatnonzero(apart <= radius).tolist()
