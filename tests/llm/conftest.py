import pytest

ODD = (
    "doc_id long, text string, lang string, source string, n_chars long, chunk long, row long, size long, score double, margin double"
)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, ties, clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    plain = "the quick brown fox jumps over the lazy dog and runs far away from here today again"
    rows = [
        (1, plain, "en", "a"), (2, plain, "en", "b"), (2, plain, "en", "b"), (3, None, None, None), (4, "", "en", "a"),
        (5, " \t\n ", "de", "a"), (None, plain, "en", None), (None, None, None, None), (6, long, "en", "c"),
        (7, long + " tail", None, "c"), (8, "one", "en", "c"), (9, "!!! 123", "fr", "c"), (10, "é" * 5000, "fr", "a"),
        (11, "der schnelle braune fuchs springt über den faulen hund und läuft weit weg von hier heute", "de", "a"),
    ]
    full = [(*r, None if r[1] is None else len(r[1]), 1, 2, 3, 0.5, None) for r in rows]
    return spark.createDataFrame(full, ODD)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], ODD)
