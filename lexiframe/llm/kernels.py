"""Vectorised byte kernels over Arrow string buffers (numpy, no per-word Python).

Words are maximal runs of bytes outside ``0x20, 0x09-0x0D`` (the pattern
``[^\\x20\\x09-\\x0D]+``; multi-byte UTF-8 characters never contain these
bytes, so splitting bytes equals splitting characters).  A word's 64-bit hash
is a polynomial over random per-byte values modulo 2**64, finished by a mixer;
it depends on the word's bytes alone, never on its place.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Documents of one kernel call hold about this many bytes (a single longer document is one call).
BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=2)
def _byte_values(lower: bool) -> np.ndarray:
    code = np.arange(256, dtype=U64)
    if lower:
        code[65:91] += U64(32)
    return mix(code + U64(0x5851F42D4C957F2D))


_POWERS: dict[bool, np.ndarray] = {}


def _powers(n: int, inverse: bool) -> np.ndarray:
    """At least ``n`` powers of the base or its inverse; the table grows and is kept."""
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        p = np.full(1 << max(16, int(n - 1).bit_length()), _INVERSE if inverse else _BASE, dtype=U64)
        p[0] = 1
        have = _POWERS[inverse] = np.multiply.accumulate(p, dtype=U64)
    return have


@dataclass
class Words:
    """Words of several documents, document after document."""

    hash: np.ndarray      # uint64, one per word
    start: np.ndarray     # byte place in the block
    end: np.ndarray
    doc: np.ndarray       # document of the word, from 0 in the block
    first: np.ndarray     # first word of each document; one more entry for the end
    data: np.ndarray      # bytes of the block
    doc_byte: np.ndarray  # first byte of each document; one more entry for the end


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string or binary column; nulls count as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES):
    """Ranges of documents whose texts together hold about ``size`` bytes."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def words_of(raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int, lower: bool = False) -> Words:
    """Hashed words of documents ``lo .. hi-1``."""
    base = int(offsets[lo])
    data = raw[base: int(offsets[hi])]
    doc_byte = offsets[lo: hi + 1] - base
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), z, z, z, np.zeros(hi - lo + 1, np.int64), data, doc_byte)
    inside = np.ones(n + 2, dtype=bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    # a word also ends where its document ends: compare with the byte before, per document
    opens = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    edges = doc_byte[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    opens[edges] |= inside[1:-1][edges]
    closes[edges - 1] |= inside[1:-1][edges - 1]
    start = np.flatnonzero(opens)
    end = np.flatnonzero(closes) + 1
    prefix = np.zeros(n + 1, dtype=U64)
    np.cumsum(_byte_values(lower)[data] * _powers(n, False)[:n], out=prefix[1:])
    h = (prefix[end] - prefix[start]) * _powers(n, True)[start]
    h = mix(h + (end - start).astype(U64))
    first = np.searchsorted(start, doc_byte)
    doc = np.repeat(np.arange(hi - lo), np.diff(first))
    return Words(h, start, end, doc, first, data, doc_byte)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, first word)`` of every window of ``size`` words inside one document."""
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h = w.hash[:n].copy()
    for i in range(1, size):
        h = mix(h * U64(0xD6E8FEB86659FD93) + w.hash[i: n + i])
    at = np.flatnonzero(w.doc[:n] == w.doc[size - 1:])
    return h[at], at


def shingle_lists(column: pa.Array, size: int, lower: bool = True) -> list[np.ndarray]:
    """The hashes of all windows of ``size`` words of every text, in order."""
    raw, offsets = string_buffers(column)
    out: list[np.ndarray] = []
    for lo, hi in blocks(offsets):
        w = words_of(raw, offsets, lo, hi, lower=lower)
        h, at = shingles(w, size)
        cut = np.searchsorted(w.doc[at], np.arange(hi - lo + 1)) if len(at) else np.zeros(hi - lo + 1, np.int64)
        out.extend(h[cut[i]: cut[i + 1]] for i in range(hi - lo))
    return out
