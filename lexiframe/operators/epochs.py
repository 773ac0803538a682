"""Epoch orders without a sort: a keyed bijection of positions.

Position ``x`` of ``n`` rows is split into ``(x / b, x % b)`` on a grid of ``a`` times
``b`` cells, the smallest near-square one with ``n`` cells or more.  Each round adds to
one half a hash of the other half (md5 of seed, epoch, round and half), which can be
undone, so the rounds permute the grid; a place beyond ``n`` is sent through again
until it is below.  Fewer than ``a`` cells lie beyond, so nearly every row needs one
pass, and a place is an expression of the position alone: any row of any epoch is
found without ordering, exchanging or even reading the others.

Defined results: NULL positions have NULL places; with one row its place is 0; a
position outside ``0 .. n - 1`` is an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.functions.hashing import hex_to_long, seeded_md5

ROUNDS = 4
#: Passes after which a place that is still beyond the rows is an error.  Below 1,024 rows
#: fewer cells than this lie beyond, so it cannot happen; above, each pass leaves less
#: than one in 32 there.
PASSES = 32


def grid(n: int) -> tuple[int, int]:
    """Sides of the grid: ``a * b >= n`` with fewer than ``a`` cells to spare."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _key(seed, epoch: Column, round_: int, half: Column) -> Column:
    return hex_to_long(seeded_md5(seed, epoch, F.lit(round_), half))


def _round(i: int, a: int, b: int, seed, epoch: Column):
    """A round as a function of the halves; odd rounds change the right one."""
    if i % 2 == 0:
        return lambda s: F.struct(((s["l"] + _key(seed, epoch, i, s["r"])) % a).alias("l"), s["r"].alias("r"))
    return lambda s: F.struct(s["l"].alias("l"), ((s["r"] + _key(seed, epoch, i, s["l"])) % b).alias("r"))


def _once(x: Column, a: int, b: int, seed, epoch: Column) -> Column:
    """One pass over the grid; the halves are bound by name, so each is computed once."""
    state = F.struct(F.floor(x / b).cast("bigint").alias("l"), (x % b).cast("bigint").alias("r"))
    for i in range(ROUNDS):
        state = F.transform(F.array(state), _round(i, a, b, seed, epoch))[0]
    return F.transform(F.array(state), lambda s: s["l"] * b + s["r"])[0]


def place_in_epoch(position: Column, n: int, epoch: Column, seed=42) -> Column:
    """The place of a row in the order of an epoch, from its position in the table."""
    a, b = grid(n)
    inside = (position >= 0) & (position < n)
    checked = F.when(inside, position.cast("bigint")).otherwise(F.raise_error(F.lit("a position lies outside the table")).cast("bigint"))
    first = _once(checked, a, b, seed, epoch)
    again = F.aggregate(F.sequence(F.lit(1), F.lit(PASSES)), first, lambda x, _: F.when(x < n, x).otherwise(_once(x, a, b, seed, epoch)))
    sure = F.transform(F.array(again), lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("no place was found")).cast("bigint")))[0]
    return F.when(position.isNotNull(), sure)


def epoch_batches(df: DataFrame, position: str, n: int, epoch: int, batch_size: int, seed=42) -> DataFrame:
    """``df`` with ``place``, ``batch_id`` and ``pos_in_batch`` of an epoch."""
    placed = df.withColumn("place", place_in_epoch(F.col(position), n, F.lit(epoch), seed))
    return placed.withColumn("batch_id", F.floor(F.col("place") / batch_size).cast("bigint")).withColumn("pos_in_batch", (F.col("place") % batch_size).cast("int"))


__all__ = ["grid", "place_in_epoch", "epoch_batches"]
