"""Groups and links against a plain walk over the library's own tokens."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from flowlens.llm import alignment
from flowlens.llm.words import texts

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def brute(rows):
    """One row for each text, from whole texts, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    known = {chr(c): bytes([c]) for c in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    for n, c in enumerate(c for c in range(256) if chr(c) not in known):
        known[chr(256 + n)] = bytes([c])
    assert decoders.ByteLevel().decode(list(known)) == b"".join(known.values()).decode("utf-8", "replace")

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    found, counts = [], Counter()
    for doc_id, text in rows:
        groups, links, sides = [], [], ([], [])
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            spelled = [b"".join(known[c] for c in a.id_to_token(i)) for i in ids[0]], [piece(i) for i in ids[1]]
            if all(b"".join(s) == b" " + text.encode() for s in spelled):
                sides = ids
                ends = [np.cumsum([len(t) for t in s]).tolist() for s in spelled]
                common = sorted(set(ends[0]) & set(ends[1]))
                left = [list(zip(ends[k], ids[k], strict=True))[::-1] for k in (0, 1)]
                for end in common:
                    part = [[], []]
                    for k in (0, 1):
                        while left[k] and left[k][-1][0] <= end:
                            part[k].append(left[k].pop()[1])
                    groups.append("|".join(",".join(map(str, p)) for p in part))
                at = [dict(zip(ends[k], ids[k], strict=True)) for k in (0, 1)]
                links = [(at[0][e], at[1][e]) for e in common]
        counts.update(links)
        found.append((doc_id, sides, ";".join(groups), len(groups), links))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted(
        (
            (i, len(s[0]), len(s[1]), n, len(k), sum(counts[p] == most[p[1]] for p in k), sum(counts[p] for p in k),
             hashlib.sha256(g.encode()).hexdigest() if g else "", g)
            for i, s, g, n, k in found
        ),
        key=repr,
    )


def ours(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_documents(spark, sf_dir):
    rows = pq.read_table(f"{sf_dir}/documents.parquet").select(["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert ours(alignment.align(docs, A, B)) == brute(rows)


def test_odd_texts(spark, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert ours(alignment.align(odd_docs, A, B)) == brute(rows)


def test_signs(spark):
    """Special tokens as plain text, marks that one side does not spell, runs of spaces, all kinds of characters."""
    texts = ["<|endoftext|> a <s>b</s>", "x▁y", "a  b   c\n\n d\t", "\u0000\x07 z", "日本語 テスト 🙂 𝔘", "é́ é", " lead", "tail ", "<0x41><unk>", "ﬁ Å"]
    rows = list(enumerate(texts * 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ours(alignment.align(docs, A, B))
    assert found == brute(rows)
    assert [r for r in found if r[0] == 1] == [(1, 0, 0, 0, 0, 0, 0, "", "")]


def ids_of(pair, values):
    ids, counts = pair.encode(*texts(pa.array(values, pa.string())))
    return [[x.tolist() for x in np.split(i, np.cumsum(c)[:-1])] for i, c in zip(ids, counts)]


def test_units_give_the_ids_of_whole_texts():
    """Texts of many units, whatever stands around the cuts."""
    rng = np.random.default_rng(3)
    signs = ["word", "Ünï", " ", "  ", "\n", " x", "don't ", "12 ", "... ", "漢 ", "  b", "a ", "'s ", "\u00a0 ", "\u2003 é", "\x1c ", "² ", "\x7f z", "̈ "]
    values = ["".join(rng.choice(signs, 300)) for _ in range(300)] + ["".join(rng.choice(signs, 100_000)), "z" * 20_000, None, "", " ", "  "]
    pair = alignment.pair_of(A, B)
    assert pair.cuts
    want = [pair.a.encode_batch([" " + (v or "") if v else "" for v in values], add_special_tokens=False), pair.b.encode([v or "" for v in values])]
    assert ids_of(pair, values) == [[e.ids for e in want[0]], want[1]]


def test_id_pairs_and_empty_table(spark, no_docs):
    docs = spark.createDataFrame([(1, "a a b"), (2, "a")], "doc_id long, text string")
    found = {(r["a_id"], r["b_id"]): (r["count"], r["best"]) for r in alignment.id_pairs(docs, A, B).collect()}
    assert sorted(found.values()) == [(1, True), (3, True)]
    assert alignment.align(no_docs, A, B).count() == 0


def test_coalescing_of_any_ranges():
    """Groups are the connected stretches of overlapping ranges."""
    start, end = np.array([0, 3, 5, 0, 2, 7]), np.array([3, 5, 9, 2, 7, 9])
    order, group = alignment.coalesced(start, end, np.array([0, 0, 0, 1, 1, 1]))
    assert dict(zip(order.tolist(), group.tolist())) == {0: 0, 3: 0, 4: 0, 1: 0, 2: 0, 5: 0}
    i, j = alignment.overlaps(start[:3], end[:3], start[3:], end[3:])
    assert list(zip(i.tolist(), j.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 1), (2, 2)]
