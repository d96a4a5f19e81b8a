"""Cached words give the same ids as the library gives for whole texts."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlens.llm.tokens import encoder
from flowlens.llm.words import split, texts

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def check(values):
    encode = encoder(PATH)
    ids, counts = encode.encode(split(*texts(pa.array(values, pa.string()))), 2)
    got = [a.tolist() for a in np.split(ids, np.cumsum(counts)[:-1])]
    want = [encode.tokenizer.encode(v or "", add_special_tokens=False).ids + [2] for v in values]
    assert got == want


def test_plain_texts():
    check(["Hello, world! It's 3.5%... (ok)", None, "", "  \t\n", "A.B,C;D", "x<|endoftext|>y", "<|ENDOFTEXT|> <b>!", "é. É, ß! 12, 3."])
    check(["don't, DON'T!! we'll. 's 'S. o'", "İi̇ ΑΣ ας. Ǆ K K.", "...", "a" * 700 + ".", "%%%a,, a%., .a"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" .,!'aAbsStT<|>\ń ")), max_size=40), min_size=1, max_size=5))
def test_any_texts(values):
    check(values)


def test_small_memory_gives_the_same_ids():
    """With room for a few words, which are forgotten and encoded again."""
    from flowlens.llm.tokens import WordEncoder

    small, large = WordEncoder(PATH, 20), encoder(PATH)
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in ("été", "x'", "Word", "日", "a.b") for b in range(30)]
    for _ in range(30):
        parts = split(*texts(pa.array([" ".join(rng.choice(words, 25)), None, "word1 word1"], pa.string())))
        for a, b in zip(small.encode(parts, 2), large.encode(parts, 2)):
            assert a.tolist() == b.tolist()
    assert len(small.memo.now.hash) < 120
