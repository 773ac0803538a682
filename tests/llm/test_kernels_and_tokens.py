"""Byte kernels against Python words; cached tokenisation against whole texts."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lexiframe.llm.kernels import blocks, shingle_lists, string_buffers, words_of
from lexiframe.llm.tokens import CachedTokenizer
from tests.llm.helpers import LOWER, WORD

ALPHABET = "abAB \n\t\r\x0b\x0c\x85\xa0  　\x1c\x1f,.'s9é́ΣσİI!²½क_<|endoftext|>"


def _texts(n, seed=1):
    rnd = random.Random(seed)
    return ["", " ", *("".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 24))) for _ in range(n))]


@pytest.mark.parametrize("size", [10, 1 << 20])
def test_words_and_hashes(size):
    texts = [*_texts(400), "long " * 5000]
    raw, offsets = string_buffers(pa.array([*texts, None]))
    seen, at = {}, 0
    for lo, hi in blocks(offsets, size):
        w = words_of(raw, offsets, lo, hi, lower=True)
        for i in range(lo, hi):
            mine = slice(w.first[i - lo], w.first[i - lo + 1])
            got = [bytes(w.data[s:e]).decode() for s, e in zip(w.start[mine], w.end[mine])]
            want = WORD.findall(([*texts, ""])[i])
            assert got == want
            for x, h in zip(want, w.hash[mine].tolist()):
                assert seen.setdefault(x.translate(LOWER), h) == h
        at = hi
    assert at == len(texts) + 1 and len(set(seen.values())) == len(seen)


def test_shingles_stay_inside_documents():
    a, b = shingle_lists(pa.array(["a b c d", "c d a b"]), 2)
    assert len(a) == len(b) == 3 and len(np.intersect1d(a, b)) == 2
    assert [len(x) for x in shingle_lists(pa.array(["", None, "a", "a b"]), 2)] == [0, 0, 0, 1]


@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_cached_tokens_equal_whole_texts(name, spaces, monkeypatch):
    monkeypatch.setattr("lexiframe.llm.tokens.CACHE_PIECES", 50)
    monkeypatch.setattr("lexiframe.llm.tokens.SLICE_CHARS", 300)
    tok = CachedTokenizer(public_tokenizers.path(name), spaces)
    texts = [*_texts(3000), "The cat's  end. " * 400]
    got = list(tok.encode_column(pa.array(texts)))
    tok.tok.encode_special_tokens = True
    want = [np.array(e.ids, dtype=tok.dtype).tobytes() for e in tok.tok.encode_batch_fast(texts, add_special_tokens=False)]
    assert got == want
