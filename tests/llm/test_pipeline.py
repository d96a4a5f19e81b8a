"""Each stage of the pipeline against brute force on that stage's own input."""

import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
import zstandard  # noqa: E402
from test_dedup import WORD, classes, kept  # noqa: E402
from test_packing import check_pieces  # noqa: E402
from test_texts import check_mix  # noqa: E402

from flowlens.llm import pivotal, zstd_langid  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The input and what each stage wrote."""
    folder = tmp_path_factory.mktemp("pipeline")
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = real.orderBy("doc_id").collect()
    texts = [r["text"] for r in rows if r["text"] and len(r["text"].split()) > 40]
    like, top = rows[0].asDict(), max(r["doc_id"] for r in rows)
    passage = " ".join(texts[0].split()[:30])
    planted = [
        texts[1], texts[1], texts[2] + " again", f"{texts[3]} {passage}", f"{passage} {texts[4]}", passage, None, "", "123 !",
    ]
    more = [like | {"doc_id": top + 1 + n, "text": t, "n_chars": None if t is None else len(t)} for n, t in enumerate(planted)]
    more += [more[0], like | {"doc_id": top + 50, "text": " ".join(texts[5].split()[::-1]), "lang": None, "source": None}]
    docs = real.unionByName(spark.createDataFrame([tuple(m[c] for c in real.columns) for m in more], real.schema))
    docs.write.parquet(f"{folder}/in/documents.parquet")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(corpus_pipeline, "scratch_dir", lambda spark, name: f"{folder}/out")
        last = corpus_pipeline.run(spark, f"{folder}/in")
    paths = [f"{folder}/in/documents.parquet"] + [f"{folder}/out/{n}-{name}" for n, (name, _) in enumerate(corpus_pipeline.STAGES)]
    tables = [spark.read.parquet(p) for p in paths]
    assert sorted(map(str, last.collect())) == sorted(map(str, tables[-1].collect()))
    return tables


def test_columns_stay(stages):
    for table in stages[1:5]:
        assert table.columns == stages[0].columns and table.count()


def test_language(stages):
    coders = [
        zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=1), write_content_size=False)
        for _, raw in zstd_langid.learn(stages[0])
    ]
    bare = zstandard.ZstdCompressor(level=6, write_content_size=False)

    def stays(text):
        data = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip().encode()
        parts = [data[i : i + 2048] for i in range(0, len(data), 2048)]
        best, after = sorted(sum(len(c.compress(p)) for p in parts) for c in coders)[:2]
        alone = sum(len(bare.compress(p)) for p in parts)
        return bool(data) and (after - best) / after >= 0.04 and (alone - best) / alone >= 0.04

    rows = stages[0].collect()
    assert Counter(stages[1].collect()) == Counter(r for r in rows if stays(r["text"]))


def test_near_duplicates(stages):
    rows = stages[1].collect()
    groups = defaultdict(list)
    for r, c in zip(rows, classes([r["text"] for r in rows]), strict=True):
        groups[c].append(r)
    assert len(groups) < len(rows)
    assert Counter(stages[2].collect()) == Counter(min(g, key=lambda r: r["doc_id"]) for g in groups.values())


def test_repeated_spans(stages):
    import hashlib

    rows, found = stages[2].collect(), stages[3].collect()
    want = kept([(r["doc_id"], r["text"]) for r in rows], 13)
    assert any(gone for _, _, gone, _ in want)
    empty = hashlib.sha256(b"").hexdigest()
    left = Counter((r["doc_id"], hashlib.sha256(" ".join(WORD.findall(r["text"])).encode()).hexdigest()) for r in found)
    assert left == Counter({(i, h): n for (i, _, _, h), n in want.items() if h != empty})
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    other = [c for c in stages[0].columns if c not in ("text", "n_chars")]
    by_id = {r["doc_id"]: r for r in rows}
    assert all(r[c] == by_id[r["doc_id"]][c] for r in found for c in other)


def test_mixture(stages):
    rows, copies = stages[3].collect(), Counter(stages[4].collect())
    assert set(copies) <= set(rows)
    by_id = Counter()
    for r, n in copies.items():
        by_id[r["doc_id"]] += n
    listed = [(r["doc_id"], r["text"], r["source"]) for r in rows]
    mixed = [r.asDict() | {"copies": by_id[r["doc_id"]], "taken": r["size"] * by_id[r["doc_id"]]} for r in pivotal.mix(stages[3]).collect()]
    check_mix(listed, mixed)


def test_packing(stages):
    check_pieces(stages[4], stages[5])


def test_empty_table_and_other_columns(spark, no_docs, sf_dir):
    """Every stage takes a table without rows, and columns named as those used within."""
    odd = no_docs.selectExpr("*", "1 AS __id", "'x' AS __text", "2 AS __lang", "3 AS variant", "4 AS copies")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf_dir)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == odd.columns


def test_columns_of_any_name_are_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    odd = docs.selectExpr("*", "doc_id + 1 AS __id", "'x' AS __text", "2 AS __lang", "doc_id AS variant", "map('a', doc_id) AS copies")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, odd, sf_dir).collect()
        assert rows and all(r["__id"] == r["doc_id"] + 1 and r["variant"] == r["copies"]["a"] == r["doc_id"] for r in rows), name


def test_intermediate_tables_go_when_the_next_stage_begins(spark, sf_dir, tmp_path):
    import os

    from flowlens.llm import common

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = common.made()
    out = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    mine = [path.split(":")[-1] for path, _ in common._MADE[start:] if path]
    out.write.parquet(f"{tmp_path}/kept")
    # A frame that still reads them keeps them.
    corpus_pipeline.language(spark, out, sf_dir)
    assert mine and all(os.path.exists(path) for path in mine)
    common.release(spark, start)
    assert not any(os.path.exists(path) for path in mine)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("texts_") and not t.isTemporary and t.name in str(mine)]
