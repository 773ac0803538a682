"""Epoch orders: permutations for every size, against a loop in Python; no exchange."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lexiframe.operators import epochs


def twin(x, n, epoch, seed):
    a, b = epochs.grid(n)
    while True:
        left, right = divmod(x, b)
        for i in range(epochs.ROUNDS):
            key = lambda half: int(hashlib.md5(f"{seed}:{epoch}:{i}:{half}".encode()).hexdigest()[:8], 16)  # noqa: B023,E731
            if i % 2 == 0:
                left = (left + key(right)) % a
            else:
                right = (right + key(left)) % b
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 101, 1000])
def test_places_are_permutations(spark, n):
    df = spark.range(n).withColumnRenamed("id", "pos")
    got = df.select("pos", *[epochs.place_in_epoch(F.col("pos"), n, F.lit(e), 7).alias(f"e{e}") for e in (0, 1)]).collect()
    for e in (0, 1):
        assert {r.pos: r[f"e{e}"] for r in got} == {x: twin(x, n, e, 7) for x in range(n)}
        assert sorted(r[f"e{e}"] for r in got) == list(range(n))
    if n > 100:
        assert sum(r.e0 == r.e1 for r in got) < n / 10 and sum(r.pos == r.e0 for r in got) < n / 10


def test_grid_is_small():
    for n in [*range(1, 3000), 10 ** 6, 10 ** 12 + 1]:
        a, b = epochs.grid(n)
        assert 0 <= a * b - n < a


def test_batches_need_no_exchange_and_outsiders_are_errors(spark):
    df = spark.range(20).withColumnRenamed("id", "pos")
    out = epochs.epoch_batches(df, "pos", 20, 3, 6)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    assert sorted(r["count"] for r in out.groupBy("batch_id").count().collect()) == [2, 6, 6, 6]
    with pytest.raises(Exception, match="outside the table"):
        epochs.epoch_batches(df, "pos", 19, 3, 6).collect()
    null = spark.createDataFrame([(None,)], "pos long")
    assert epochs.epoch_batches(null, "pos", 19, 3, 6).first().place is None
