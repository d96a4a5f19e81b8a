"""Language ID, scores, URL rules and mixing."""

import math
import re
import zlib
from collections import Counter, defaultdict

from flowlens.llm import context_mixing, pivotal, queries, url_trie, zstd_langid

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    found = zstd_langid.identify(docs).collect()
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert sum(r["rejected"] for r in found) / len(found) < 0.02


def test_noise_is_rejected(spark):
    import random

    rng = random.Random(3)
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(rng.randint(20, 400))) for _ in range(100)]
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = [4 * 10**6 + i for i in range(2000) if zlib.crc32(str(4 * 10**6 + i).encode()) % 4 == 2][:100]
    added = spark.createDataFrame([(i, t, "en") for i, t in zip(held, noise, strict=True)], "doc_id long, text string, lang string")
    found = zstd_langid.identify(real.unionByName(added)).collect()
    assert all(r["rejected"] for r in found if r["doc_id"] in held)
    kept = [r for r in found if r["held_out"] and r["doc_id"] not in held]
    assert sum(r["rejected"] for r in kept) / len(kept) < 0.02


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    found = zstd_langid.identify(odd_docs).collect()
    assert len(found) == odd_docs.count()
    for r in found:
        if r["doc_id"] in (3, 4, 5, 9):
            assert (r["lang_pred"], r["rejected"]) == ("und", True)
        assert 0 <= r["score"] <= 1
    left = zstd_langid.accepted(odd_docs)
    assert left.columns == odd_docs.columns and left.count() == sum(not r["rejected"] for r in found)
    assert zstd_langid.identify(no_docs).count() == 0
    assert {r["lang_pred"] for r in zstd_langid.identify(odd_docs.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def base_scores(docs):
    counts = Counter()
    for i, text in docs:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            counts.update(WORD.findall(lower(text)))
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    out = Counter()
    for i, text in docs:
        tokens = [*WORD.findall(lower(text)), None]
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        held = i is not None and zlib.crc32(str(i).encode()) % 10 == 0
        out[i, held, len(tokens), sum(counts[t] > 0 for t in tokens), n, round(base, 6)] += 1
    return out


def test_scores(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for table in (docs, odd_docs):
        found = context_mixing.scores(table).collect()
        got = Counter(
            (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found
        )
        assert got == base_scores([tuple(r) for r in table.select("doc_id", "text").collect()])
        for r in found:
            assert r["score"] < 0 and math.isclose(r["bits_per_byte"], -r["score"] * math.log2(10) / r["n_bytes"])
    assert context_mixing.scores(no_docs).count() == 0


def test_scores_learn(spark):
    """Better than counting words on held-out documents, and equal in a second run."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    runs = [sorted(map(tuple, context_mixing.scores(docs).collect())) for _ in range(2)]
    assert runs[0] == runs[1]
    held = [r for r in runs[0] if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)
    assert sum(-r[6] * math.log2(10) for r in held) / sum(r[7] for r in held) < 2.3


def test_scores_know_the_words_before(spark):
    """Held-out texts of known words score better in the order that was learned than shuffled."""
    names = [f"{a}{b}" for a in "bcdfghklmn" for b in ("ado", "elu", "ira")]
    after = {w: names[(7 * i + 3) % len(names)] for i, w in enumerate(names)}

    def running(i):
        out = [names[i % len(names)]]
        while len(out) < 25:
            out.append(after[out[-1]])
        return out

    texts = [running(i) for i in range(300)]
    train = [(i, " ".join(t)) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    held = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    rows = [*train, (held[0], " ".join(texts[0])), (held[1], " ".join(sorted(texts[0])))]
    found = {r["doc_id"]: r for r in context_mixing.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    a, b = found[held[0]], found[held[1]]
    assert math.isclose(a["base_score"], b["base_score"]) and a["n_known"] == b["n_known"] == a["n_tokens"]
    assert a["score"] > 0.7 * b["score"]


def plain_bits(rows):
    """log2 of the chance of each text by the unlearned model: plain counts of tuples, one choice after another."""
    texts = [(i, [*(w.encode() for w in WORD.findall(lower(t))), b"\n"], lower(t).encode()) for i, t in rows]
    trains = [i is not None and zlib.crc32(str(i).encode()) % 10 > 0 for i, *_ in texts]

    def gates(raw):
        sign, out, at = 0, [], 0
        for w in WORD.findall(raw.decode()):
            start = raw.index(w.encode(), at)
            for j in range(at, start):
                sign = 1 + (raw[j] * 31 + raw[j + 1]) % 31 if raw[j] >= 0xC0 else sign
            out.append(sign)
            at = start
            for j in range(start, start + len(w.encode())):
                sign = 1 + (raw[j] * 31 + (raw[j + 1] if j + 1 < len(raw) else 0)) % 31 if raw[j] >= 0xC0 else sign
            at = start + len(w.encode())
        return [*out, sign]

    def firsts(units, raw):
        for k, (u, g) in enumerate(zip(units, gates(raw), strict=True)):
            tail = units[k - 1][-2:] if k else "start"
            yield u[0], [("t", tail, g), ("g", g), ("n",)]

    def others(u):
        full = u if u == b"\n" else u + b" "
        for j in range(1, len(full)):
            yield full[j], [("w", n, full[max(0, j - n) : j]) for n in (1, 2, 3, 99)]

    def pairs(units):
        for k, u in enumerate(units):
            yield (units[k - 2] if k > 1 else None, units[k - 1] if k else None), u

    counts, after = Counter(), {}
    for (_, units, raw), train in zip(texts, trains, strict=True):
        if train:
            for byte, contexts in [*firsts(units, raw), *(x for u in units for x in others(u))]:
                counts.update((c, byte) for c in contexts)
            for pair, u in pairs(units):
                after.setdefault(pair, Counter())[u] += 1

    def spelled(byte, contexts):
        total = 0.0
        for d in range(8):
            odds = 0.0
            for c in contexts:
                whole = sum(counts[c, x] for x in range(256) if x >> (8 - d) == byte >> (8 - d))
                same = sum(counts[c, x] for x in range(256) if x >> (7 - d) == byte >> (7 - d))
                odds += 0.3 * math.log((same + 0.4) / (whole - same + 0.4))
            total += chance(odds)
        return total

    def chance(odds):
        odds = max(-12, min(12, odds))
        at = min(max((odds / 8 + 1) / 2 * 24, 0), 24 - 1e-6)
        low = [1 / (1 + math.exp(-((int(at) + j) / 24 * 2 - 1) * 8)) for j in (0, 1)]
        return math.log2(0.5 / (1 + math.exp(-odds)) + 0.5 * (low[0] * (1 - at % 1) + low[1] * (at % 1)))

    out = []
    for (_, units, raw), train in zip(texts, trains, strict=True):
        bits = 0.0
        for (pair, u), (byte, contexts) in zip(pairs(units), firsts(units, raw), strict=True):
            seen = after.get(pair, Counter())
            total, most = sum(seen.values()), max(seen.values(), default=0)
            guess = min((context_mixing_next(w), w) for w in seen if seen[w] == most)[1] if seen else None
            right = guess == u
            most, total = most - (train and right), total - (train and total > 0)
            right = right and most > 0
            if total > 0:
                odds = 0.3 * math.log((most + 0.4) / (total - most + 0.4))
                bits += chance(odds if right else -odds)
            if not (total > 0 and right):
                bits += spelled(byte, contexts) + sum(spelled(b, c) for b, c in others(u))
        out.append(bits)
    return out


def context_mixing_next(word):
    """The hash by which equal counts are told apart, as the operator has it."""
    import numpy as np
    import pyarrow as pa

    from flowlens.llm.common import frozen

    blob = frozen(context_mixing._rows([1], pa.array(["" if word == b"\n" else word.decode()]), [True], [0]))
    return int(np.asarray(context_mixing.Chunk(blob).next)[0])


def test_scores_equal_plain_counts(spark, monkeypatch):
    """With weights as they start, each text's score is that of a plain walk over its choices."""
    monkeypatch.setattr(context_mixing, "_sampled", lambda docs, n_docs: None)
    texts = [
        "the cat sat on the mat", "the cat sat on the hat", "The cat, the été cat\tsat on", "", None, "a b a b a b a c", "x", "über été ça va été",
        "the cat sat on the mat", "mat hat cat the cat sat x",
    ]
    rows = [(i, t) for i, t in enumerate(texts, 1)] + [(None, "the cat sat"), (17, "the cat sat on a mat"), (43, "été ça va")]
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = Counter((r["doc_id"], round(r["score"] * math.log2(10), 3)) for r in context_mixing.scores(docs).collect())
    want = Counter((i, round(b, 3)) for (i, _), b in zip(rows, plain_bits(rows), strict=True))
    assert {k[0] for k in found} == {k[0] for k in want}
    got, want = ({k[0]: k[1] for k in c} for c in (found, want))
    assert all(abs(got[i] - want[i]) < 0.01 for i in want)


def test_scores_learn_from_texts_of_any_length(spark, monkeypatch):
    """Training texts that are all longer than 16 KiB teach the weights, too."""
    words = [f"{a}{b}" for a in "bcdfghklmn" for b in ("ado", "elu", "ira", "ost")]
    rows = [(i, " ".join(words[(i * 7 + j * j * 3 + j // 9) % len(words)] for j in range(4500))) for i in range(1, 12)]
    assert all(len(t) > 16 << 10 for _, t in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learned = sum(r["score"] for r in context_mixing.scores(docs).collect())
    monkeypatch.setattr(context_mixing, "_sampled", lambda docs, n_docs: None)
    assert learned > 0.99 * sum(r["score"] for r in context_mixing.scores(docs).collect())


def test_bytes_of_words_with_equal_counts_are_predicted_once():
    """What weights are learned from grows with distinct predictions, not with the bytes of the dictionary; no prediction changes."""
    import numpy as np
    import pyarrow as pa

    from flowlens.llm import tally

    words = [f"{a}{b}ing".encode() for a in "bcdfghklmnprst" for b in ("all", "ell", "ill", "oll")] + [b"\n", b"y" * 48, b"x"]
    length = np.array([len(w) for w in words])
    kind = np.full(len(words), context_mixing.WHOLE)
    data = np.frombuffer(b"".join(words), np.uint8)
    spelled = context_mixing.Spelled(data, np.cumsum(length) - length, length, kind)
    counts = (np.arange(len(words)) % 3).astype(np.uint64)
    asked = pa.Table.from_batches(context_mixing._contexts(0, spelled.contexts(30), counts[spelled.word], 30, 0, 0))
    reply = []
    for bucket in range(context_mixing.KINDS):
        reply += context_mixing._walked(asked.filter(pa.compute.equal(asked["bucket"], bucket << 40)).combine_chunks()).to_pylist()
    row = context_mixing._folded(7, spelled, np.arange(len(words), dtype=np.uint64), counts, reply, 30).to_pylist()[0]
    which = tally.unsqueeze(row["which"]).astype(np.int64)
    found = [(of, context_mixing._path_counts(reply, k)) for k, (_, of) in enumerate(spelled.contexts(30))]
    for left_out in (0, 1):
        plain = context_mixing.Predictions(spelled.byte, found, 0, left_out)
        once = context_mixing._unfolded(row["byte"], row["places"], row["widths"], row["paths"], left_out)
        for a, b in zip(plain.at(np.arange(len(which))), once.at(which), strict=True):
            assert np.array_equal(a, b)
    assert len(row["byte"]) < len(which) / 2
    weight = tally.unsqueeze(row["weight"])
    assert weight.sum() == counts[spelled.word].sum() and len(weight) == len(row["byte"])


def test_chunks_are_parsed_once():
    """A packed chunk has the units, entries and numbers of the one that was parsed."""
    import numpy as np
    import pyarrow as pa

    texts = ["The cat, été the CAT", "", "y" * 200 + " the " + "é" * 30, "\x1f a\tb\x0bc  ", "the cat sat on the mat"]
    rows = context_mixing._rows([3, None, 17, 10, 4], pa.array(texts), [True, True, False, True, True], [5, 6, 7, 8, 9])
    for part in (rows, rows.slice(0, 0), rows.slice(1, 1)):
        one = context_mixing.Chunk(part)
        two = context_mixing.Chunk.of(one.packed())
        for name in ("known", "data", "lengths", "which", "gate", "doc", "long_doc", "byte", "next", "pair", "tail", "trains", "held_out", "is_token"):
            assert np.array_equal(getattr(one, name), getattr(two, name)), name
        assert one.table.equals(two.table) and np.array_equal(one.coded(), two.coded()) and np.array_equal(one.adds(), two.adds())
    # Words and ends; the third text has parts of 48 bytes, and its end in another chunk.
    assert np.bincount(context_mixing.Chunk(rows).doc).tolist() == [6, 1, 8, 5, 7]


def test_scores_do_not_depend_on_the_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    one = {r["doc_id"]: r["score"] for r in context_mixing.scores(docs).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        other = {r["doc_id"]: r["score"] for r in context_mixing.scores(docs.repartition(13, "n_chars")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert one == other


def test_scores_of_very_long_texts(spark):
    """A text of many pieces, and one of a single word: tokens, bytes and base scores are those of the whole."""
    import numpy as np

    rng = np.random.default_rng(1)
    text = " ".join(f"w{x}" for x in rng.zipf(1.3, 5_500_000) % 50_000)
    assert len(text) > 20_000_000
    rows = [(1, text), (2, "y" * 300_000), (3, "w1 w2 " + "y" * 300_000 + " w3"), (4, "w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in context_mixing.scores(docs).collect()}
    want = base_scores(rows)
    got = Counter((i, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for i, r in found.items())
    assert {k[:5] for k in got} == {k[:5] for k in want}
    assert all(math.isclose(a[5], b[5], rel_tol=1e-9) for a, b in zip(sorted(got), sorted(want)))
    assert found[1]["n_bytes"] == len(text) + 2 and found[2]["n_bytes"] == 300_002
    assert found[1]["bits_per_byte"] < 8


def by_hand(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    host = re.split(r"[/?#]", rest, maxsplit=1)[0] if rest is not None else ""
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0] if rest is not None else ""
    host = lower(host)
    fits = [
        (len(h.split(".")) if h else 0, len(p), v, h + p) for v, h, p in rules
        if (host == h or host.endswith("." + h) or not h) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, default, None))
    return host, path, best[3], best[2]


URLS = [
    "https://a.Example.net/en/1?q#f", "http://example.net/de/1", "http://net", "http://net/", "http://xnet/", "x://EXAMPLE.com/de/",
    "http://b.example.com/de", "http://c.org/fr/", "http://org/fr/x", "no scheme", "", None, "://", "http:///p", "a://h?x/en/", "a://u@h.net:80/",
    "http://x.net:80/en/", "http://ü.net/é", "a://b://c.net/", "http://example.net/en", "http://example.net/english", "http://..net/a//b",
    "http://example.net/en/\nx", "http://m.example.net." + "/x" * 3000,
]
RULES = [
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
    ("block", "example.net", "/eng"), ("allow", "example.net", "/eng"), ("block", "", "/p"), ("allow", "net", "/a//"), ("block", "c.net", ""),
]


def test_url_rules(spark):
    schema = "page_id long, url string, host string, rule int, verdict int"
    pages = spark.createDataFrame([(i, u, "h", 1, 2) for i, u in enumerate([*URLS, *URLS[:2]])] + [(None, URLS[0], "h", 1, 2)], schema)
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    want = sorted((i if i is not None else -1, *by_hand(u, RULES)) for i, u, *_ in pages.collect())
    for limit in (url_trie.MAX_BROADCAST, 0):
        found = url_trie.judge(pages, rules, max_broadcast=limit)
        rows = sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in map(tuple, found.collect()))
        assert [tuple(map(str, r)) for r in rows] == [tuple(map(str, r)) for r in want], limit
    assert url_trie.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_trie.judge(pages, rules.limit(0)).collect()} == {"allow"}


def check_mix(docs, rows):
    size = Counter()
    for i, text, source in docs:
        size[source] += len(WORD.findall(text or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in size if s is None]
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(order)}
    target, full = {}, set()
    while True:  # share out again what full sources leave
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        share = {s: left * weight[s] / sum(weight[t] for t in order if t not in full) for s in order if s not in full}
        over = {s for s in share if share[s] > 3 * size[s] + 1e-9}
        if not over:
            break
        full |= over
    target = {s: 3 * size[s] if s in full else share[s] for s in order}
    taken, longest = Counter(), defaultdict(int)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in docs)
    for r in rows:
        assert r["source_size"] == size[r["source"]] and math.isclose(r["target"], target[r["source"]], abs_tol=1e-6)
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s in order:
        assert abs(taken[s] - target[s]) <= longest[s] / 2 + 1e-6


def test_mix(spark, odd_docs, no_docs):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for docs in (real, odd_docs):
        listed = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        rows = pivotal.mix(docs, group=6).collect()
        check_mix(listed, rows)
        again = pivotal.mix(docs.repartition(5), group=6).collect()
        assert sorted(map(repr, again)) == sorted(map(repr, rows))
    out = pivotal.repeated(real)
    counts = Counter(r["doc_id"] for r in out.collect())
    want = {r["doc_id"]: r["copies"] for r in pivotal.mix(real).collect() if r["copies"]}
    assert counts == want and out.columns == real.columns
    assert pivotal.repeated(odd_docs).columns == odd_docs.columns
    assert pivotal.mix(no_docs).count() == 0 and pivotal.repeated(no_docs).count() == 0


def test_mix_is_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = pivotal.mix(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", text)


def test_each_operator_has_a_query():
    names = [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES]
    assert sorted(names) == list(range(1, 14))


def test_copies_are_dealt_out_over_rows_with_other_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a b c", "en", "x", 5), (1, "a b c", "de", "x", 5), (1, "a b c", None, "x", 5), (1, "a b c", None, "x", 5)]
    rows += [(2, "d e f g", "en", "x", 7), (None, None, "fr", None, None)]
    docs = spark.createDataFrame(rows, schema)
    # One source, taken once on average: every row stays as it is.
    assert Counter(map(tuple, pivotal.repeated(docs, weights=(1.0,)).where("source = 'x'").collect())) == Counter(rows[:5])
    two = spark.createDataFrame([*rows[:5], (3, "h " * 60, "en", "y", 120)], schema)
    taken = Counter(r["doc_id"] for r in pivotal.repeated(two).collect())
    mixed = Counter()
    for r in pivotal.mix(two).collect():
        mixed[r["doc_id"]] += r["copies"]
    assert taken == +mixed


def test_very_long_urls_take_no_longer(spark):
    """One segment, many segments and many labels of megabytes, by trie and by join."""
    import time

    trie = url_trie.Trie([("block", "example.com", "/" + "a" * 40), ("allow", "example.com", "/a"), ("block", "com", "/b/c/")])
    hosts = ["example.com", "x." * 200_000 + "example.com"]
    paths = ["/" + "a" * 1_000_000, "/b/c/" + "d/" * 400_000, "/b" * 400_000, "/a/" + "z" * 1_000_000]
    start = time.time()
    found = [trie.find(h, p) for h in hosts for p in paths]
    assert time.time() - start < 1
    want = [("block", "example.com/" + "a" * 40), ("block", "com/b/c/"), None, ("allow", "example.com/a")]
    assert found == want * 2
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)], "page_id long, url string")
    rules = spark.createDataFrame([("block", "example.com", "/" + "a" * 40), ("allow", "example.com", "/a"), ("block", "com", "/b/c/")], "verdict string, host string, path string")
    for limit in (url_trie.MAX_BROADCAST, 0):
        rows = url_trie.judge(pages, rules, max_broadcast=limit, default="none").orderBy("page_id").collect()
        assert [r["verdict"] for r in rows] == [w[0] if w else "none" for w in want] * 2
