"""Delimited files whose quoted cells hold line breaks, read by many tasks per file.

A line break ends a record only where the quotes before it are balanced, and that
is known without reading a file from its start: quotes are counted per input
split, a prefix sum over the splits (one row each) gives the parity at every
split's border, and with it

* the lines before a split's first line with an odd number of quotes continue a
  record of an earlier split, if the split starts inside quotes;
* the lines from its last such line on open a record that a later split ends, if
  the split ends inside quotes;
* all other lines form whole records, put together where they were read.

Only the first two kinds, at most two pieces of records per split, are exchanged.
Records go to Spark's own ``from_csv``.  A file whose quotes do not balance is an
error that names the file.

Lines end in ``\\n`` or ``\\r\\n``; blank records are skipped; every quote sign
counts, so files that put single quote signs into unquoted cells need another
reader.  The splits of one read are the same in all its passes; a split that one
pass saw and another did not is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiframe.session import cut_lineage

def _lines(spark: SparkSession, path) -> DataFrame:
    """Physical lines with their quote signs, file, split and place; places ascend within a split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"))


def split_table(lines: DataFrame) -> DataFrame:
    """One row per input split: whether it starts inside quotes (``inside``), its
    first place, its first and last place with an odd number of quotes, whether it
    ends inside quotes, and the split that owns the record open at its start."""
    odd = F.when(F.col("quotes") % 2 == 1, F.col("place"))
    counted = cut_lineage(lines.groupBy("file", "split").agg(
        F.sum("quotes").alias("quotes"), F.min("place").alias("first"), F.max("place").alias("last"), F.min(odd).alias("first_odd"), F.max(odd).alias("last_odd")), "splits")
    in_order = Window.partitionBy("file").orderBy("split")
    before = F.coalesce(F.sum("quotes").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = counted.select("*", (before % 2 == 1).alias("inside"), ((before + F.col("quotes")) % 2 == 1).alias("open"))
    opens = F.when(F.col("open") & F.col("last_odd").isNotNull(), F.col("split"))
    owner = F.last(opens, ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    return known.withColumn("owner", owner)


def check_balanced(splits: DataFrame) -> None:
    """Raise an error if a file ends inside quotes."""
    bad = splits.groupBy("file").agg(F.sum("quotes").alias("quotes")).filter("quotes % 2 = 1").orderBy("file").first()
    if bad is not None:
        raise ValueError(f"unterminated quote: {bad['file']} holds {bad['quotes']} quote signs")


def _whole(batches):
    """Whole records from the lines of splits, in order: every line that starts
    outside quotes starts a record."""
    held: list[str] = []  # lines of the record that is open at the end of a batch
    start = None
    odd = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        value = batch.column("value")
        quotes = pc.count_substring(value, '"').to_numpy(zero_copy_only=False)
        after = (odd + np.cumsum(quotes)) % 2
        begins = np.flatnonzero(np.r_[odd, after[:-1]] == 0)
        ends = len(value) if after[-1] == 0 else (begins[-1] if len(begins) else 0)
        cut = [b for b in begins.tolist() if b < ends]
        files, firsts = batch.column("file"), batch.column("is_first")
        if held and (len(begins) or after[-1] == 0):  # the open record ends in this batch
            stop = int(begins[0]) if len(begins) else len(value)
            record = "\n".join([*held, *value.slice(0, stop).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([record]), pa.array([start[0]]), pa.array([start[1]])], names=["record", "file", "is_first"])
            held = []
        if cut:
            offsets = pa.array([*cut, int(ends)], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, value.cast(pa.string()))
            at = pa.array(cut, pa.int64())
            yield pa.RecordBatch.from_arrays([pc.binary_join(lists, "\n"), files.take(at), firsts.take(at)], names=["record", "file", "is_first"])
        if after[-1]:
            if not held:
                start = (files[int(ends)].as_py(), firsts[int(ends)].as_py())
            held += value.slice(int(ends)).to_pylist()
        odd = int(after[-1])
    if held:
        raise ValueError("a split ended inside quotes that an earlier pass saw balanced")


def records(spark: SparkSession, path) -> DataFrame:
    """``(record, file, is_first)``: the text of every record; ``is_first`` marks the
    first of each file.  Runs a pass that counts quotes."""
    lines = _lines(spark, path)
    splits = cut_lineage(split_table(lines), "splits")
    check_balanced(splits)
    # one row per input split (of up to spark.sql.files.maxPartitionBytes bytes), so the size is bounded
    # by the input's bytes over that setting, and lines keep their order
    at = F.broadcast(splits.select("file", "split", "inside", "open", "first", "last", "first_odd", "last_odd", "owner"))
    seen = lines.join(at, ["file", "split"], "left")
    known = F.col("place").between(F.col("first"), F.col("last"))
    seen = seen.filter(F.when(known, True).otherwise(F.raise_error(F.concat(F.lit("splits changed between passes: "), F.col("file"))).cast("boolean")))
    head = F.col("inside") & (F.col("first_odd").isNull() | (F.col("place") <= F.col("first_odd")))
    tail = F.col("open") & F.col("last_odd").isNotNull() & (F.col("place") >= F.col("last_odd"))
    first = (F.col("split") == 0) & (F.col("place") == F.col("first"))
    whole = seen.filter(~head & ~tail).select("value", "file", first.alias("is_first")).mapInArrow(_whole, "record string, file string, is_first boolean")
    # a line may end one record and open the next only by odd quotes, so it is head or tail, not both
    pieces = seen.filter(head | tail).select(
        "file", F.when(head, F.col("owner")).otherwise(F.col("split")).alias("owner"), F.struct("split", "place", "value").alias("line"), first.alias("is_first"))
    across = pieces.groupBy("file", "owner").agg(F.sort_array(F.collect_list("line")).alias("lines"), F.max("is_first").alias("is_first"))
    across = across.select(F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("record"), "file", "is_first")
    out = whole.unionByName(across).withColumn("record", F.regexp_replace("record", r"\r$", ""))
    return out.filter(~F.col("record").rlike(r"^\s*$") | F.col("is_first"))


def read_quoted(spark: SparkSession, path, present: Sequence[str], sep: str, header: bool, malformed: str, corrupt: str) -> DataFrame:
    """All cells of the records as strings: the columns ``present`` and ``corrupt``,
    the text of a record with another number of cells (see ``read_delimited``)."""
    rows = records(spark, path)
    schema = ", ".join(f"`{c}` string" for c in [*present, corrupt])
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "columnNameOfCorruptRecord": corrupt,
               "mode": "FAILFAST" if malformed == "fail" else "PERMISSIVE"}
    cells = F.from_csv("record", schema, options)
    if header:
        same = F.array(*[cells[c] for c in present]) == F.array(*[F.lit(c) for c in present])
        wrong = F.raise_error(F.concat(F.col("file"), F.lit(f": the header is not {', '.join(present)} but "), F.col("record"))).cast("boolean")
        rows = rows.filter(F.when(F.col("is_first"), F.when(same, False).otherwise(wrong)).otherwise(True))
    parsed = rows.filter("record <> ''").select(cells.alias("c")).select("c.*")
    return parsed.filter(F.col(f"`{corrupt}`").isNull()) if malformed == "drop" else parsed
