"""Token ids of texts by the tokenizers library, each distinct word encoded once in a while.

Holds for vocabularies that drop white space, ignore case and cut letters from marks, as word_bpe_49k.json:

- The ids of a text are those of its words in turn. Words are cut at ASCII white space only; what else the
  vocabulary's rules cut or join lies within a word and is left to the library.
- A-Z in lower case gives the same ids, unless a word could hold a special token, which starts with `<`.
- Marks (.,;:!?) that follow an ASCII letter and end a word are a piece of their own.
- A word of letters alone is one piece, whose last token, and no other, has the end-of-word mark. So many such words
  are encoded as one text, which takes half the time, and told apart by that mark.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pandas as pd

from flowlens.llm.memo import Encoded, Memo
from flowlens.llm.words import Words, lowered

# Words a worker remembers, about 30 bytes each, twice.
CAPACITY = 1 << 19
# Words of letters that are encoded as one text.
JOINED = 64
# Letters up to here are written as one character that stays one in lower case and in normal form, but for one.
LAST_LETTER, DOTTED_I = "\u024f", "\u0130"
_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = True
_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class WordEncoder:
    def __init__(self, path: str, capacity: int = CAPACITY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(names.values()) + 1, bool)
        self.ends_word[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.memo = Memo(self._ids, 1, capacity)

    def _ids(self, values: list[bytes]) -> Encoded:
        texts = [v.decode("utf-8", "replace") for v in values]
        plain = np.array([t.isascii() and t.isalpha() or t.isalpha() and max(t) <= LAST_LETTER and DOTTED_I not in t for t in texts], bool)
        at, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        joined = [" ".join([texts[i] for i in at[lo : lo + JOINED].tolist()]) for lo in range(0, len(at), JOINED)]
        flat = np.array(list(chain.from_iterable(self._encoded(joined))), np.int64)
        last = np.flatnonzero(self.ends_word[flat])
        if len(last) != len(at):
            raise ValueError("this vocabulary does not mark the end of each word")
        others = self._encoded([texts[i] for i in rest.tolist()])
        counts = np.concatenate([np.diff(last, prepend=-1), np.fromiter(map(len, others), np.int64, len(others))])
        flat = np.concatenate([flat, np.array(list(chain.from_iterable(others)), np.int64)])
        # Back in the order of the values.
        order = np.argsort(np.concatenate([at, rest]), kind="stable")
        begin, count = (np.cumsum(counts) - counts)[order], counts[order]
        stop = np.cumsum(count)
        return [(flat[np.arange(len(flat)) + np.repeat(begin - (stop - count), count)], count)], np.zeros(len(values), np.uint8)

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, words: Words, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, with end_id after each text, and the number of ids of each text."""
        words = _units(words)
        which, distinct = pd.factorize(words.hashes())
        first = np.empty(len(distinct), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        place = self.memo.places(distinct, lambda some: words.values(first[some]))
        flat, count = self.memo.gather(place[which])
        per_doc = np.bincount(words.doc, weights=count, minlength=words.n_docs).astype(np.int64)
        return np.insert(flat.astype(np.uint32), np.cumsum(per_doc), np.uint32(end_id)), per_doc + 1


def _units(words: Words) -> Words:
    """Words in lower case, marks at their ends cut off."""
    data, start, end = words.data, words.start, words.end
    low = lowered(data)
    special = np.flatnonzero(data == ord("<"))
    if len(special):
        held = np.unique(np.searchsorted(start, special, "right") - 1)
        edge = np.zeros(len(data) + 1, np.int32)
        edge[start[held]] += 1
        edge[end[held]] -= 1
        low = np.where(np.cumsum(edge)[:-1] > 0, data, low)
    core = end.copy()
    live = np.flatnonzero(_MARK[data[end - 1]]) if len(end) else end
    while len(live):  # back over the marks
        core[live] -= 1
        live = live[core[live] > start[live]]
        live = live[_MARK[data[core[live] - 1]]]
    cut = (core < end) & (core > start)
    cut[cut] = _LETTER[data[core[cut] - 1]]
    core = np.where(cut, core, end)
    at = np.flatnonzero(cut)
    return Words(
        low,
        np.insert(start, at + 1, core[at]),
        np.insert(core, at + 1, end[at]),
        np.insert(words.doc, at + 1, words.doc[at]),
        words.n_docs,
    )
