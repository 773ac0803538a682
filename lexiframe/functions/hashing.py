"""Seeded, partition-independent randomness from md5 of ``seed:key``.

Every random choice in the package (shuffles, splits, sampling, augmentation
positions) is a pure function of the seed and the row key, so results do not
depend on partitioning, task retries or execution order.  The same hex digest
is available in DuckDB, which makes the choices checkable in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seeded_md5(seed, *keys) -> Column:
    """md5 hex of ``'<seed>:<k1>:<k2>...'`` (keys cast to string)."""
    parts = [F.lit(str(seed))]
    for k in keys:
        parts.append(F.lit(":"))
        parts.append(_as_col(k).cast("string"))
    return F.md5(F.concat(*parts))


def hex_bucket(hex_col: Column, hex_digits: int = 4) -> Column:
    """Leading ``hex_digits`` of a hex digest as an int; monotone in the digest."""
    return F.conv(F.substring(hex_col, 1, hex_digits), 16, 10).cast("int")


def hex_to_long(hex_col: Column, hex_digits: int = 8) -> Column:
    """Leading 32 bits of a hex digest as a non-negative BIGINT."""
    return F.conv(F.substring(hex_col, 1, hex_digits), 16, 10).cast("bigint")
