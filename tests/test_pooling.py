"""Pooling over sequences of several states, against plain Python."""

import random

import pytest

from lexiframe.operators.pooling import pool_states


def test_pooling_of_ordered_masked_sequences(spark):
    rnd = random.Random(1)
    rows = [(k, o, [round(rnd.random(), 3) for _ in range(3)], rnd.randrange(2)) for k in range(6) for o in range(rnd.randrange(1, 9))]
    rows += [(7, 0, [1.0, 2.0, 3.0], 0), (8, None, [1.0, 1.0, 1.0], 1), (9, 1, None, 1), (None, 2, [4.0, 5.0, 6.0], 1), (None, 1, [7.0, 0.0, 1.0], 1),
             (10, 0, [2.0, 0.0, 0.0], 1), (10, 0, [1.0, 9.0, 9.0], 1)]
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "k long, o long, s array<double>, m int").repartition(5)
    seqs = {}
    for k, o, s, m in rows:
        if o is not None and s is not None:
            seqs.setdefault(k, []).append((o, s, m))
    first = {r.k: (r.n_states, r.pooled) for r in pool_states(df, "k", "o", "s", 3).collect()}
    assert first == {k: (len(v), min(v)[1]) for k, v in seqs.items()}
    for how, f in (("mean", lambda x: sum(x) / len(x)), ("max", max)):
        got = {r.k: r.pooled for r in pool_states(df, "k", "o", "s", 3, how, "m").collect()}
        for k, v in seqs.items():
            on = [s for _, s, m in v if m]
            assert got[k] == (pytest.approx([f([s[i] for s in on]) for i in range(3)]) if on else None)


def test_states_are_pooled_before_the_exchange(spark):
    df = spark.range(100).selectExpr("id % 3 as k", "id as o", "array(id * 1.0, 2.0) as s")
    plan = pool_states(df, "k", "o", "s", 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_min" in plan and "collect" not in plan
    with pytest.raises(ValueError, match="unknown"):
        pool_states(df, "k", "o", "s", 2, "median")
