"""Exact tokenisation by the ``tokenizers`` library with a word cache.

A text is cut at places that no token crosses: before white space that follows
a non-space character, and after a run of letters (or letters and digits) that
starts with a Latin letter, where neither a letter nor a digit follows.  Both
kinds of pre-tokeniser used here (byte-level, word-end) keep letters, numbers,
and the rest apart, so each piece is encoded by itself and the ids are joined.
Pieces seen before come from a bounded cache that lives as long as the Python
worker.  Encoded whole, without cuts: texts with U+001C-U+001F (white space for
Python, not for the tokeniser), texts that the tokeniser's NFC step would
change, and texts with the two letters whose lower case depends on their place.

A new piece that is a single run of Latin letters is one pre-token, so it goes
straight to the tokeniser's model.  Other new pieces are encoded many at a
time: joined by a special token, which the library always splits off first, so
that each piece is still encoded alone.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np

#: Pieces kept by one Python worker; later ones are encoded again when they return.
CACHE_PIECES = 350_000
#: Characters of the texts that are cut into pieces at once, and rows taken from Arrow at once.
SLICE_CHARS, SLICE_ROWS = 1_000_000, 512
#: Pieces encoded in one call.
JOINED = 512
#: White space for Python alone; letters whose lower case depends on their place.
_ODD, _CASED = "\x1c\x1d\x1e\x1f", "\u0130\u03a3"
#: Latin letters (a subset of the letters is enough: it only decides where cuts are made).
_L = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_WITH_SPACE = re.compile(rf"\s?[{_L}]+[^\W_]*|\s*[^\s{_L}]*[{_L}]+[^\W_]*|\s*[^\s{_L}]+|\s+$")
_NO_SPACE = re.compile(rf"[{_L}]+[^\W_]*|[^\s{_L}]*[{_L}]+[^\W_]*|[^\s{_L}]+")
_PLAIN = {True: re.compile(rf" ?[{_L}]+"), False: re.compile(rf"[{_L}]+")}


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level vocabularies write bytes with: printable
    bytes stand for themselves, the others follow from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def cached_tokenizer(path: str, keeps_space: bool) -> CachedTokenizer:
    return CachedTokenizer(path, keeps_space)


class CachedTokenizer:
    """``keeps_space``: white space makes ids of its own (byte-level vocabularies)."""

    def __init__(self, path: str, keeps_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            steps = str(json.load(f).get("normalizer"))
        self.composes, self.lowers = "'NFC'" in steps, "'Lowercase'" in steps
        added = {i: str(t.content) for i, t in self.tok.get_added_tokens_decoder().items() if t.special}
        self.special = tuple(added.values())
        self.sep_id, self.sep = next(iter(added.items()), (None, ""))
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.cut = (_WITH_SPACE if keeps_space else _NO_SPACE).findall
        self.plain, self.letters = _PLAIN[keeps_space].fullmatch, _byte_letters()
        self.cache: dict[str, bytes] = {}

    def _alone(self, text: str) -> bytes:
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype).tobytes()

    def _encode(self, pieces: list[str]) -> list[bytes]:
        known: dict[str, bytes] = {}
        run = self.tok.model.tokenize
        for p in pieces:
            if self.plain(p):
                word = p.encode().decode("latin-1").translate(self.letters)
                known[p] = np.array([t.id for t in run(word)], dtype=self.dtype).tobytes()
        rest = [p for p in pieces if p not in known]
        known.update(zip(rest, self._encode_joined(rest), strict=True))
        return [known[p] for p in pieces]

    def _encode_joined(self, pieces: list[str]) -> list[bytes]:
        if self.sep_id is None:
            return [self._alone(p) for p in pieces]
        out, width = [], self.dtype.itemsize
        for i in range(0, len(pieces), JOINED):
            part = pieces[i: i + JOINED]
            joined = self.sep.join(part)
            self.tok.encode_special_tokens = False
            ids = np.array(self.tok.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=self.dtype)
            at = np.flatnonzero(ids == self.sep_id) * width
            if len(at) != len(part) - 1 or any(joined.count(s) != (len(part) - 1) * (s == self.sep) for s in self.special):
                out.extend(map(self._alone, part))  # a piece holds the string of a special token
                continue
            raw = ids.tobytes()
            out.extend(raw[a:b] for a, b in zip([0, *(at + width).tolist()], [*at.tolist(), len(raw)], strict=True))
        return out

    def _cut(self, text: str) -> list[str] | None:
        """The pieces of a text; None: encode it whole."""
        if any(c in text for c in _ODD) or (self.composes and not unicodedata.is_normalized("NFC", text)):
            return None
        if self.lowers:
            return None if any(c in text for c in _CASED) else self.cut(text.lower())
        return self.cut(text)

    def encode_column(self, column):
        """Yield the ids of each text of an Arrow string column."""
        for i in range(0, len(column), SLICE_ROWS):
            yield from self.encode(column.slice(i, SLICE_ROWS).to_pylist())

    def encode(self, texts):
        """Yield the ids of each text as bytes of ``self.dtype``, in order."""
        at, cache = 0, self.cache
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to]) <= SLICE_CHARS):
                chars += len(texts[to])
                to += 1
            cuts = [self._cut(t) for t in texts[at:to]]
            pieces: set[str] = set()
            for cut in cuts:
                pieces.update(cut or ())
            fresh = list(pieces.difference(cache))
            cache.update(zip(fresh, self._encode(fresh), strict=True))
            get = cache.__getitem__
            for t, cut in zip(texts[at:to], cuts, strict=True):
                yield self._alone(t) if cut is None else b"".join(map(get, cut))
            for p in fresh[: max(0, len(cache) - CACHE_PIECES)]:
                del cache[p]
            at = to
