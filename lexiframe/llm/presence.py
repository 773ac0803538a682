"""Rows whose key may stand in a set of keys, told where the rows lie.

The set is a bitmap of its keys' hashes, cut into pages of 4 KB that are
broadcast.  A row whose bit is not set is surely not in the set and need not
move; only the others meet the keys themselves by a join, which decides.  The
bitmap has a fixed largest size: sets beyond it let more rows move, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.storage import written

#: Bits for each key; fewest and most bits of a bitmap (256 KB and 8 MB).
BITS_PER_KEY, FEWEST, MOST = 16, 1 << 21, 1 << 26


def split_by(rows: DataFrame, key: Column, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``(may, not)``: the rows whose ``key`` may be a value of ``keys[column]``, and
    those for which it surely is none.  ``keys`` should be a written table (it is
    read twice); NULL keys and repeated ones are allowed."""
    bits = min(MOST, max(FEWEST, 1 << (BITS_PER_KEY * keys.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    hashed = keys.select(place(F.col(column)).alias("_lf_at"))
    dealt = hashed.select(F.bitmap_bucket_number("_lf_at").alias("_lf_page"), F.bitmap_bit_position("_lf_at").alias("_lf_bit")).repartition("_lf_page")
    pages = written(dealt.groupBy("_lf_page").agg(F.bitmap_construct_agg("_lf_bit").alias("_lf_bits")), "key-bits")
    at = rows.withColumn("_lf_at", place(key)).join(F.broadcast(pages), F.bitmap_bucket_number("_lf_at") == F.col("_lf_page"), "left")
    bit = F.bitmap_bit_position("_lf_at")
    byte = F.conv(F.hex(F.substring("_lf_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    names = [F.col(f"`{c}`") for c in rows.columns]
    return at.filter(may).select(*names), at.filter(~may).select(*names)
