"""A vocabulary as a minimal perfect hash: tokens get their ids where they are.

Terms are dealt over parts by hash and every part is built by its own task (compress,
hash and displace; Belazzougui et al. 2009): terms fall into buckets of about four,
large buckets first look for a seed that sends all their terms to free slots, buckets
of one term name a free slot outright, so a part of ``m`` terms has exactly ``m``
slots.  A slot holds the term's id and 128 bits of hash, which a token must match, so an
unknown token is mapped with a chance of about 2 ** -128 per look-up: never.

A term takes 20 bytes and a quarter of a 4-byte seed: ``BYTES_PER_TERM``.  The table is
shipped to every task, so its size is checked first: beyond ``MOST_TERMS`` terms it is
not built and the caller joins instead (``operators.batching.token_ids``), with equal
results.

Defined results: as ``batching.token_ids``: unknown tokens get the unknown id, a NULL or
wordless text an empty array; equal terms in the vocabulary are an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.functions.text import word_tokens
from lexiframe.operators.batching import FIRST_TERM_ID, UNK_ID, pieces

#: Terms of a part and of a bucket; seeds tried at once; terms of the largest table that is shipped.
PART_TERMS, BUCKET, TRIES, MOST_TERMS = 1 << 15, 4, 64, 4_000_000
#: Rows whose tokens are looked up at once.
PIECE_ROWS = 256
BYTES_PER_TERM = 8 + 8 + 4 + 4 // BUCKET

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _slot(h: np.ndarray, seed, size) -> np.ndarray:
    return (_mix(h.view(np.uint64) + np.asarray(seed).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.asarray(size).astype(np.uint64)).astype(np.int64)


def _bucket(h: np.ndarray, buckets) -> np.ndarray:
    return (_mix(h.view(np.uint64)) % np.asarray(buckets).astype(np.uint64)).astype(np.int64)


def displace(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of the buckets (``-1 - slot`` for buckets of one term) and the slot of each term."""
    m = len(one)
    buckets = -(-m // BUCKET)
    if len(np.unique(np.stack([one, two]), axis=1).T) != m:
        raise ValueError("equal terms in a vocabulary")
    of = _bucket(one, buckets)
    order = np.argsort(of, kind="stable")
    size = np.bincount(of, minlength=buckets)
    begin = np.cumsum(size) - size
    seeds, slot, free = np.zeros(buckets, np.int32), np.zeros(m, np.int64), np.ones(m, bool)
    for b in np.argsort(-size, kind="stable"):
        terms = order[begin[b]: begin[b] + size[b]]
        if len(terms) < 2:
            break
        first = 0
        while True:
            tried = np.arange(first, first + TRIES)
            at = _slot(np.repeat(two[terms][None], TRIES, axis=0), tried[:, None], m)
            ordered = np.sort(at, axis=1)
            good = np.flatnonzero(free[at].all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1))
            if len(good):
                seeds[b], slot[terms] = tried[good[0]], at[good[0]]
                free[at[good[0]]] = False
                break
            first += TRIES
    alone = np.flatnonzero(size == 1)
    left = np.flatnonzero(free)[: len(alone)]
    slot[order[begin[alone]]] = left
    seeds[alone] = -1 - left
    return seeds, slot


def _build(rows: pa.Table) -> pa.Table:
    one, two = (rows.column(c).to_numpy() for c in ("one", "two"))
    seeds, slot = displace(one, two)
    inverse = np.argsort(slot)
    ids = rows.column("term_id").to_numpy().astype(np.int32)
    return pa.table({"part": [rows.column("part")[0].as_py()], "n": pa.array([len(one)], pa.int64()), "seeds": [seeds.tobytes()],
                     "one": [one[inverse].tobytes()], "two": [two[inverse].tobytes()], "ids": [ids[inverse].tobytes()]},
                    schema=pa.schema([("part", pa.int64()), ("n", pa.int64()), *[(c, pa.binary()) for c in ("seeds", "one", "two", "ids")]]))


def _hashes(token):
    return F.xxhash64(token), F.xxhash64(F.lit(1), token)


@dataclass
class PerfectVocabulary:
    """The parts one after the other: slots and seeds of each part begin at its offset."""

    size: np.ndarray
    seeds: np.ndarray
    one: np.ndarray
    two: np.ndarray
    ids: np.ndarray

    @classmethod
    def build(cls, vocab: DataFrame, most: int = MOST_TERMS) -> PerfectVocabulary | None:
        """From ``(token, term_id)``; None if there are more than ``most`` terms."""
        n = vocab.count()
        if n > most:
            return None
        parts = max(1, -(-n // PART_TERMS))
        one, two = _hashes(F.col("token"))
        keyed = vocab.select(one.alias("one"), two.alias("two"), "term_id").withColumn("part", F.pmod("one", F.lit(parts)))
        made = keyed.groupBy("part").applyInArrow(_build, "part long, n long, seeds binary, one binary, two binary, ids binary")
        rows = {r["part"]: r for r in made.collect()}  # at most BYTES_PER_TERM * most bytes
        none = {"n": 0, "seeds": b"", "one": b"", "two": b"", "ids": b""}
        rows = [rows.get(p, none) for p in range(parts)]
        return cls(np.array([r["n"] for r in rows], dtype=np.int64), *[np.frombuffer(b"".join(bytes(r[c]) for r in rows), kind)
                                                                     for c, kind in (("seeds", np.int32), ("one", np.int64), ("two", np.int64), ("ids", np.int32))])

    def look_up(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Ids of hashed tokens; -1 for unknown ones."""
        if not len(self.ids) or not len(one):
            return np.full(len(one), -1, np.int64)
        buckets = -(-self.size // BUCKET)
        part = one % len(self.size)
        n, b = np.maximum(self.size[part], 1), np.maximum(buckets[part], 1)
        seed = self.seeds[np.minimum((np.cumsum(buckets) - buckets)[part] + _bucket(one, b), len(self.seeds) - 1)]
        slot = np.where(seed < 0, -1 - seed, _slot(two, np.maximum(seed, 0), n)) + (np.cumsum(self.size) - self.size)[part]
        slot = np.minimum(slot, len(self.ids) - 1)
        return np.where((self.one[slot] == one) & (self.two[slot] == two), self.ids[slot], -1)

    def token_ids(self, df: DataFrame, key: str, text: str = "text", out: str = "input_ids") -> DataFrame:
        """``batching.token_ids`` without an exchange of tokens."""
        shared = df.sparkSession.sparkContext.broadcast(self)  # checked when it was built
        tokens = F.coalesce(word_tokens(text), F.array().cast("array<string>"))
        rows = df.select(key, F.transform(F.array(tokens), lambda t: F.struct(
            F.transform(t, lambda x: _hashes(x)[0]).alias("one"), F.transform(t, lambda x: _hashes(x)[1]).alias("two")))[0].alias("_lf_h"))

        def run(batches):
            for batch in pieces(batches, PIECE_ROWS):
                h = batch.column("_lf_h")
                one, two = h.field("one"), h.field("two")
                ids = shared.value.look_up(one.flatten().to_numpy(), two.flatten().to_numpy())
                known = np.where(ids >= 0, ids + FIRST_TERM_ID, UNK_ID).astype(np.int32)
                cut = np.r_[0, np.cumsum(one.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(pa.array(cut), pa.array(known))], names=[key, out])

        return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, `{out}` array<int>")
