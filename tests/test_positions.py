"""Positions of rows over several files and row groups, against the files read in order."""

import os

import pyarrow as pa
import pyarrow.parquet as pq

from lexiframe.sources.positions import PositionIndex


def write(folder, sizes, group=7):
    """Files of the given sizes whose names do not sort as they were written."""
    rows, at = [], 0
    for k, n in enumerate(sizes):
        values = [f"f{k}r{i}" for i in range(n)]
        pq.write_table(pa.table({"v": values, "pos": list(range(n))}), os.path.join(folder, f"p{k:02d}.parquet"), row_group_size=group)
        rows += values
        at += n
    return rows


def test_every_position(spark, tmp_dir):
    rows = write(tmp_dir, [20, 0, 1, 33, 5])
    index = PositionIndex.build(spark, tmp_dir)
    assert index.rows == len(rows)
    got = {r["at"]: r["v"] for r in index.with_positions("at").collect()}
    assert got == dict(enumerate(rows))
    for lo, hi in ((0, 1), (18, 24), (20, 21), (0, 59), (58, 70), (59, 60), (-3, 2)):
        part = index.rows_between(lo, hi, "at").collect()
        assert sorted((r["at"], r["v"]) for r in part) == [(i, v) for i, v in enumerate(rows) if lo <= i < hi]
    one = index.row_at(21)
    assert one.columns == ["v", "pos"] and [r.v for r in one.collect()] == [rows[21]]
    assert index.row_at(59).collect() == [] and index.row_at(-1).collect() == []


def test_a_fetch_scans_one_file_and_sorts_nothing(spark, tmp_dir):
    write(tmp_dir, [20, 1, 33, 5])
    index = PositionIndex.build(spark, tmp_dir)
    one = index.row_at(22)
    one.collect()
    plan = one._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "Sort" not in text and "Exchange" not in text
    scan = plan.collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() == 1
    whole = index.with_positions()
    whole.collect()
    text = whole._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in text.split("Initial Plan")[0] and "rangepartitioning" not in text


def test_empty_table(spark, tmp_dir):
    spark.createDataFrame([], "v string").write.parquet(f"{tmp_dir}/e")
    index = PositionIndex.build(spark, f"{tmp_dir}/e")
    assert index.rows == 0 and index.row_at(0).collect() == [] and index.with_positions().collect() == []
