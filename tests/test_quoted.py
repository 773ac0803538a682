"""Quoted line breaks read by several tasks per file, against Python's csv module."""

import csv
import io
import os
import random

import pytest

from lexiframe.sources import delimited as dl
from lexiframe.sources import quoted


@pytest.fixture()
def small_splits(spark):
    """Sets the bytes of an input split for a test."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(n) for n in names]

    def use(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield use
    for n, v in zip(names, old, strict=True):
        spark.conf.set(n, v)


def cell(rnd):
    return "".join(rnd.choice(["a", "b", " ", ",", '"', '""', "\n", "\n\n", "\r\n", "é", "漢", "\t"]) for _ in range(rnd.randrange(9)))


def rows_of(seed, n):
    rnd = random.Random(seed)
    return [[str(i), cell(rnd), rnd.choice(["x", "y,z", 'q"']), cell(rnd) + "end"] for i in range(n)]


def write(path, rows, sep=",", end="\n", header=("id", "a", "b", "c")):
    out = io.StringIO()
    w = csv.writer(out, delimiter=sep, lineterminator=end, quoting=csv.QUOTE_MINIMAL)
    w.writerows([header, *rows] if header else rows)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(out.getvalue())
    return out.getvalue()


def read(path, sep=","):
    with open(path, encoding="utf-8", newline="") as f:
        return [tuple(r) for r in csv.reader(f, delimiter=sep) if r]


@pytest.mark.parametrize("size", [7, 33, 100_000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_every_border_of_a_split(spark, tmp_dir, small_splits, size, end):
    """Split borders fall into quoted cells, onto quote signs and line breaks."""
    path = os.path.join(tmp_dir, "f.csv")
    rows = rows_of(size, 40)
    write(path, rows, end=end)
    small_splits(size)
    got = dl.read_csv(spark, path, ["id", "a", "b", "c"], multi_line="split", na_tokens=None)
    want = sorted(read(path)[1:])
    assert want == sorted(tuple(r) for r in rows)
    assert sorted(tuple(v or "" for v in r) for r in got.collect()) == want
    if size < 100:
        assert quoted._lines(spark, path).select("split").distinct().count() > 10


def test_several_files_headers_and_tabs(spark, tmp_dir, small_splits):
    small_splits(50)
    for k in range(3):
        write(os.path.join(tmp_dir, f"p{k}.tsv"), rows_of(k, 20), sep="\t")
    want = sorted(r for k in range(3) for r in read(os.path.join(tmp_dir, f"p{k}.tsv"), "\t")[1:])
    got = dl.read_tsv(spark, tmp_dir, ["id", "a", "b", "c"], multi_line="split", na_tokens=None)
    assert sorted(tuple(v or "" for v in r) for r in got.collect()) == want
    by_name = dl.read_tsv(spark, tmp_dir, ["c", "id"], multi_line="split")
    assert sorted((r.id, r.c) for r in by_name.collect()) == sorted((r[0], r[3]) for r in want)
    write(os.path.join(tmp_dir, "p4.tsv"), rows_of(4, 3), sep="\t", header=("id", "b", "a", "c"))
    with pytest.raises(Exception, match="the header is not"):
        dl.read_tsv(spark, tmp_dir, ["id"], multi_line="split").collect()


def test_headerless_layout(spark, tmp_dir, small_splits):
    small_splits(40)
    path = os.path.join(tmp_dir, "liar.tsv")
    rows = [[f"{i}.json", "false", f'He said "{i}"\nand\tleft', *["x"] * 10, "a\nspeech"] for i in range(12)]
    write(path, rows, sep="\t", header=None)
    got = dl.read_liar(spark, path, multi_line="split")
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in rows)


@pytest.mark.parametrize("size", [16, 1000])
def test_an_unterminated_quote_is_an_error(spark, tmp_dir, small_splits, size):
    small_splits(size)
    path = os.path.join(tmp_dir, "f.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('id,a\n1,"one\ntwo"\n2,"never closed\n3,x\n4,y\n')
    with pytest.raises(ValueError, match="unterminated quote: .*f.csv"):
        dl.read_csv(spark, path, ["id", "a"], multi_line="split")


def test_wrong_numbers_of_cells(spark, tmp_dir):
    path = os.path.join(tmp_dir, "f.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('id,a\n1,"one\ntwo"\n2\n3,x,y\n\n4,z\n')
    kept = dl.read_csv(spark, path, ["id", "a"], multi_line="split", malformed="keep")
    assert sorted(r.id for r in kept.collect()) == ["1", "2", "3", "4"] and kept.filter("_malformed is not null").count() == 2
    assert sorted(r.id for r in dl.read_csv(spark, path, ["id", "a"], multi_line="split", malformed="drop").collect()) == ["1", "4"]
    with pytest.raises(Exception):
        dl.read_csv(spark, path, ["id", "a"], multi_line="split").collect()


def test_only_pieces_of_records_are_exchanged(spark, tmp_dir, small_splits):
    """Whole records never leave the task that read them."""
    small_splits(64)
    path = os.path.join(tmp_dir, "f.csv")
    write(path, rows_of(9, 50))
    plan = quoted.records(spark, path)._jdf.queryExecution().executedPlan().toString()
    whole, across = plan.split("MapInArrow", 1)[1], plan
    assert "Exchange hashpartitioning(file" in across and plan.count("Exchange hashpartitioning") == 1
    assert "BroadcastHashJoin" in whole


def test_empty_file_and_blank_lines(spark, tmp_dir):
    path = os.path.join(tmp_dir, "f.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("id,a\n\n\n1,x\n\n")
    assert [tuple(r) for r in dl.read_csv(spark, path, ["id", "a"], multi_line="split").collect()] == [("1", "x")]
    with open(path, "w", encoding="utf-8") as f:
        f.write("id,a\n")
    assert dl.read_csv(spark, path, ["id", "a"], multi_line="split").count() == 0
