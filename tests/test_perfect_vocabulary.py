"""The perfect hash: minimal, equal to the join, unknown tokens unmapped, bounded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiframe.operators import batching as bt
from lexiframe.operators import perfect_vocabulary as pv


def hashes(seed, n):
    rng = np.random.default_rng(seed)
    return rng.integers(-2 ** 63, 2 ** 63 - 1, n), rng.integers(-2 ** 63, 2 ** 63 - 1, n)


@pytest.mark.parametrize("n", [1, 2, 5, 100, 5000])
def test_every_slot_is_used_once(n):
    one, two = hashes(n, n)
    seeds, slot = pv.displace(one, two)
    assert sorted(slot) == list(range(n)) and len(seeds) == -(-n // pv.BUCKET)


def test_equal_terms_are_an_error():
    one, two = hashes(1, 3)
    with pytest.raises(ValueError, match="equal terms"):
        pv.displace(np.r_[one, one[0]], np.r_[two, two[0]])


@pytest.mark.parametrize("part", [1 << 15, 50])
def test_ids_equal_the_join(spark, monkeypatch, part):
    """Also over many parts; unknown tokens get the unknown id."""
    monkeypatch.setattr(pv, "PART_TERMS", part)
    vocab = spark.range(700).select(F.concat(F.lit("w"), "id").alias("token"), F.col("id").cast("int").alias("term_id"))
    docs = spark.range(60).select("id", F.when(F.col("id") == 3, None).when(F.col("id") == 4, "  ").otherwise(
        F.array_join(F.transform(F.sequence(F.lit(0), F.col("id")), lambda i: F.concat(F.lit("w"), (i * 37) % 1400)), " ")).alias("text"))
    found = pv.PerfectVocabulary.build(vocab)
    assert len(found.ids) == 700 and sorted(found.ids) == list(range(700))
    got = {r["id"]: r["input_ids"] for r in found.token_ids(docs, "id").collect()}
    assert got == {r["id"]: r["input_ids"] for r in bt.token_ids(docs, "id", vocab).collect()}
    assert any(pv.UNK_ID in v for v in got.values())
    stored = sum(a.nbytes for a in (found.seeds, found.one, found.two, found.ids))
    assert stored <= 700 * (pv.BYTES_PER_TERM + 1) + 64 * len(found.size)


def test_tokens_are_not_exchanged_and_the_size_is_checked(spark):
    vocab = spark.range(30).select(F.concat(F.lit("w"), "id").alias("token"), F.col("id").cast("int").alias("term_id"))
    docs = spark.createDataFrame([(1, "w1 w2 zz")], "id long, text string")
    found = pv.PerfectVocabulary.build(vocab)
    assert "Exchange" not in found.token_ids(docs, "id")._jdf.queryExecution().executedPlan().toString()
    assert pv.PerfectVocabulary.build(vocab, most=29) is None
    empty = pv.PerfectVocabulary.build(vocab.filter("term_id < 0"))
    assert empty.token_ids(docs, "id").first().input_ids == [pv.UNK_ID] * 3
