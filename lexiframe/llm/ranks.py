"""Gapless numbers without one big window: places inside a part plus the part's offset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_offsets(numbered: DataFrame, keys: list[str], part: str, local: str, weight, out: str) -> DataFrame:
    """``numbered`` holds, per ``part`` and ``keys``, a local place ``local``
    (gapless, or a running sum of ``weight``).  Adds ``out``: the place over
    all parts in ascending order of ``part``.

    The window runs over one row per part and key, never over the rows
    themselves; the offsets are joined by part and key, so a key that holds a
    third of all rows is spread over its parts.
    """
    sums = numbered.groupBy(*keys, part).agg(F.sum(weight).alias("_w"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(part).alias("_p"),
                          F.coalesce(F.sum("_w").over(before), F.lit(0)).cast("long").alias("_before"))
    on = F.col(part) == F.col("_p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = numbered.join(offsets, on)
    return joined.withColumn(out, F.col(local) + F.col("_before")).drop("_p", "_before", *[f"_k_{k}" for k in keys])
