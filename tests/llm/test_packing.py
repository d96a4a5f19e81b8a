"""Token files and packing against plain Python."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from flowlens.llm import best_fit, rans

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text, end):
    from tokenizers import Tokenizer

    if not hasattr(ids_of, "t"):
        ids_of.t = Tokenizer.from_file(PATH)
    return ids_of.t.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def best_fit_by_item(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, room in enumerate(rooms) if room >= n]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(size - n)
    return len(rooms)


def test_plan_packs_as_item_by_item():
    rng = random.Random(1)
    for _ in range(60):
        size = rng.choice([5, 10, 17, 50])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 300))]
        slots = sorted(best_fit.plan(Counter(lengths), size))
        used = defaultdict(list)
        for n, count in Counter(lengths).items():
            for rank in range(count):
                _, first, seq, offset = [s for s in slots if s[0] == n and s[1] <= rank][-1]
                used[seq + rank - first].append((offset, n))
        for places in used.values():
            at = 0
            for offset, n in sorted(places):
                assert offset == at
                at += n
            assert at <= size
        assert len(used) == best_fit_by_item(lengths, size)


def check_pieces(docs, found, size=4096):
    rows = found.collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = ids_of(r["text"], 1)
        for p in range(-(-len(ids) // size)):
            part = ids[p * size : (p + 1) * size]
            want[(r["doc_id"], p, p * size, len(part), crc(part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    used = defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= size
    assert len(used) == best_fit_by_item([r["length"] for r in rows], size)


def test_pack(spark, sf_dir, odd_docs, no_docs):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd_docs):
        check_pieces(docs, best_fit.pack(docs, PATH))
    assert best_fit.pack(no_docs, PATH).count() == 0


def test_kept_ids(spark, odd_docs):
    rows = best_fit.pack(odd_docs, PATH, size=64, keep_ids=True).collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)


def test_coder_round_trip():
    rng = np.random.default_rng(3)
    for n, symbols in ((1, 1), (511, 3), (513, 40), (300_000, 2000), (140_000, 49_000)):
        ids = (rng.zipf(1.3, n) % symbols).astype(np.uint32) * 3
        names, counts = np.unique(ids, return_counts=True)
        table = rans.scaled(dict(zip(names.tolist(), counts.tolist(), strict=True)))
        assert table[1].sum() == 1 << table[2] and table[1].min() >= 1
        coder = rans.Coder(*table)
        states, places, payload = coder.encode(ids)
        assert (coder.decode(n, states, places, payload) == ids).all()


def test_files(spark, sf_dir, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = rans.round_trip(docs, PATH, part_ids=20_000).orderBy("doc_id").collect()
    at = 0
    for row, doc in zip(found, docs.orderBy("doc_id").collect(), strict=True):
        ids = ids_of(doc["text"], 2)
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (doc["doc_id"], at, len(ids), crc(ids))
        at += len(ids)
    rows = sorted(rans.round_trip(odd_docs, PATH, part_ids=500).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(len(rows))]
    want = Counter((r["doc_id"], crc(ids_of(r["text"], 2))) for r in odd_docs.collect())
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in rows) == want
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert rans.round_trip(no_docs, PATH).count() == 0


def test_damage_is_found(spark, odd_docs):
    from pyspark.sql import functions as F

    from flowlens.session import scratch_dir

    path = scratch_dir(spark, "damage")
    rans.write(odd_docs, path, PATH)
    blocks = spark.read.parquet(f"{path}/blocks").withColumn("crc", F.col("crc") + 1)
    blocks.write.parquet(f"{path}/bad/blocks")
    for part in ("table", "parts"):
        spark.read.parquet(f"{path}/{part}").write.parquet(f"{path}/bad/{part}")
    with pytest.raises(Exception, match="damaged"):
        rans.read(spark, f"{path}/bad").collect()
