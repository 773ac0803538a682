"""Sharding by jump consistent hashing (Lamping and Veach 2014).

A key's shard is computed from the key and the number of shards alone; there
is no ring table.  Going from n to n + 1 shards moves a key either nowhere or
into the new shard, so an expected 1 / (n + 1) of the rows move.

Defined results: a NULL key counts as key 0 mixed with a fixed salt; a NULL
text has no bytes (size 1, crc 0); equal ids share a shard; repeated rows keep
one slot each; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.kernels import mix
from lexiframe.llm.ranks import with_offsets
from lexiframe.llm.storage import plus, written

#: Keys are mixed before the jumps, so that neighbouring ids do not jump alike.
NULL_KEY = -0x6A09E667F3BCC909


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, 0 to ``shards`` - 1, for all keys at once."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = mix(keys.astype(np.int64).view(np.uint64))
    shard = np.full(len(state), -1, dtype=np.int64)
    nxt = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = nxt[live]
        s = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        state[live] = s
        draw = ((s >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        jump = np.floor((shard[live] + 1) * (float(1 << 31) / draw))
        nxt[live] = np.minimum(jump, shards).astype(np.int64)
        live = live[nxt[live] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """Column expression: the shard of a long key."""
    @F.pandas_udf("int")
    def jump(k):
        return __import__("pandas").Series(jump_hash(k.to_numpy(dtype=np.int64), shards).astype(np.int32))

    return jump(F.coalesce(key.cast("long"), F.lit(NULL_KEY)))


def assign_shards(df: DataFrame, key: str, shards: int, out: str = "shard", grown: str | None = None) -> DataFrame:
    """Add the shard of every row, and with ``grown`` its shard among one more.
    No row moves: the shard is a function of the key."""
    df = df.withColumn(out, shard_of(F.col(key), shards))
    return df.withColumn(grown, shard_of(F.col(key), shards + 1)) if grown else df


def _number(batches):
    """Number the rows of each shard in this part, in the order they come in."""
    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        shard = batch.column("shard").to_numpy(zero_copy_only=False)
        local = np.zeros(len(shard), dtype=np.int64)
        for s in np.unique(shard):
            at = np.flatnonzero(shard == s)
            local[at] = seen.get(s, 0) + np.arange(len(at))
            seen[s] = seen.get(s, 0) + len(at)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(shard), part, dtype=np.int64)), pa.array(local)],
            names=[*batch.schema.names, "_part", "_local"])


def with_slots(assigned: DataFrame, order: list[str], slot: str = "slot") -> DataFrame:
    """Add a gapless place inside each ``shard``, ascending by ``order``.

    Rows are range-partitioned by ``order`` and a running row number (so that
    neither an id nor a group of equal rows has to fit one task) and numbered
    where they lie; offsets come from one row per part and shard."""
    tied = written(assigned.withColumn("_tie", F.monotonically_increasing_id()), "sharded")
    keys = [*order, "_tie"]
    parts = tied.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = plus(parts.schema, _part="long", _local="long")
    numbered = written(parts.mapInArrow(_number, schema), "slots")
    return with_offsets(numbered, ["shard"], "_part", "_local", F.lit(1), slot).drop("_tie", "_part", "_local")


def write_shards(df: DataFrame, key: str, shards: int, path: str, max_rows_per_file: int = 1_000_000) -> None:
    """Write ``df`` as one folder per shard (``shard=0`` ...).  Tasks write
    what they hold, so a large shard is many files and never one task."""
    assign_shards(df, key, shards).write.option("maxRecordsPerFile", max_rows_per_file).partitionBy("shard").parquet(path)


def op5_jump_shards(spark, sf_dir):
    """All documents into 16 shards by ``doc_id`` (law ``key``)."""
    from lexiframe.llm.storage import table

    raw = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).cast("long").alias("text_crc32"), F.lit("key").alias("law"))
    sharded = assign_shards(docs, "doc_id", 16, grown="grown_shard")
    return with_slots(sharded, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
