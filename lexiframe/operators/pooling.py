"""Pooling of hidden states: rows ``(key, order, state)`` are the states of a sequence.

Every pooled value is an aggregate that tasks start before the exchange, so a long
sequence costs one vector per task and is never gathered.  ``first`` is the state of
the smallest order (first-token pooling), ``mean`` and ``max`` go over the states whose
mask is not 0.

Defined results: of states that share the smallest order the smallest vector is
taken; NULL states and NULL orders are left out; a sequence whose states are all
masked has NULL for ``mean`` and ``max``, but a first state; a sequence without any
state has no row; NULL keys are one sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pool_states(df: DataFrame, key: str, order: str, state: str, dim: int, how: str = "first", mask: str | None = None, out: str = "pooled") -> DataFrame:
    """``(key, n_states, pooled)`` of every sequence of ``dim``-wide states."""
    rows = df.filter(F.col(order).isNotNull() & F.col(state).isNotNull())
    on = F.lit(True) if mask is None else F.col(mask) != 0
    v = F.col(state).cast("array<double>")
    if how == "first":
        pooled = F.min(F.struct(F.col(order).alias("o"), v.alias("v")))["v"]
    elif how in ("mean", "max"):
        f = F.avg if how == "mean" else F.max
        cells = F.array(*[f(F.when(on, v[i])) for i in range(dim)])
        pooled = F.when(F.count_if(on) > 0, cells)
    else:
        raise ValueError(f"unknown pooling {how}")
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_states"), pooled.alias(out))
