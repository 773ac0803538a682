"""Splits and ranks: exact sizes, disjoint and exhaustive, independent of partitioning."""

import math

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiframe.functions.hashing import seeded_md5
from lexiframe.operators import ranking as rk


def _ids(spark, n, parts=4, labels=("a", "b", "c")):
    df = spark.range(n).select(F.col("id").alias("key"),
                               F.element_at(F.array(*[F.lit(x) for x in labels]),
                                            (F.col("id") % len(labels) + 1).cast("int")).alias("label"))
    return df.repartition(parts)


def test_md5_rank_equals_single_sort(spark):
    df = _ids(spark, 3000)
    got = {r.key: r.rank for r in rk.md5_rank(df, "key", 7).collect()}
    ref = df.withColumn("h", seeded_md5(7, "key")).withColumn(
        "r", F.row_number().over(Window.orderBy("h", "key")) - 1)
    want = {r.key: r.r for r in ref.collect()}
    assert got == want


def test_split_two_way_sizes_n90(spark):
    # 0.7 * 90 = 62.99999999999999 in double arithmetic -> 62 train rows.
    df = _ids(spark, 90)
    rows = rk.split_two_way(df, "key", 42, train_size=0.7).collect()
    n_train = sum(r.split == "train" for r in rows)
    assert n_train == math.floor(0.7 * 90) == 62
    assert len(rows) == 90


def test_stratified_split_exact_and_partition_independent(spark):
    df = _ids(spark, 1000, labels=("x", "y", "z", "w"))
    a = {r.key: r.split for r in rk.stratified_split(df.repartition(1), "key", "label", 42).collect()}
    b = {r.key: r.split for r in rk.stratified_split(df.repartition(17), "key", "label", 42).collect()}
    assert a == b and len(a) == 1000
    labels = {r.key: r.label for r in df.collect()}
    for lab in set(labels.values()):
        keys = [k for k, v in labels.items() if v == lab]
        n = len(keys)
        n_test = math.ceil(0.3 * n)
        n_val = math.ceil((2 / 7) * (n - n_test))
        got = [a[k] for k in keys]
        assert got.count("test") == n_test
        assert got.count("val") == n_val
        assert got.count("train") == n - n_test - n_val


def test_balanced_downsample(spark):
    df = _ids(spark, 100, labels=("a", "b", "c")).union(
        spark.range(100, 110).select(F.col("id").alias("key"), F.lit("d").alias("label")))
    out = rk.balanced_downsample(df, "key", "label", 42)
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {"a": 10, "b": 10, "c": 10, "d": 10}


def test_skewed_label_split(spark):
    # one label holds most rows: exact sizes still hold
    df = spark.range(5000).select(F.col("id").alias("key"),
                                  F.when(F.col("id") < 4000, "hot").otherwise("cold").alias("label"))
    out = rk.stratified_split(df, "key", "label", 1, test_size=0.3, val_size=None)
    c = {(r.label, r.split): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert c[("hot", "test")] == 1200 and c[("cold", "test")] == 300


def test_row_at_and_batches(spark):
    df = spark.range(0, 500, 3).select(F.col("id").alias("pos"))
    row = rk.row_at(df, "pos", 10).collect()
    assert [r.pos for r in row] == [30]
    b = rk.assign_batches(df, "pos", 8).collect()
    sizes = {}
    for r in b:
        sizes[r.batch_id] = sizes.get(r.batch_id, 0) + 1
    assert max(sizes) == (len(b) - 1) // 8
    assert all(v == 8 for k, v in sizes.items() if k < max(sizes))


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(None if i % 4 == 0 else i, i) for i in range(40)], "key long, v long")
    assert sorted(r["rank"] for r in rk.seeded_shuffle(df, "key", 7, out="rank").collect()) == list(range(40))
    batches = rk.assign_batches(df, "key", 8).collect()
    assert len(batches) == 40 and all(r.batch_id in (0, 1) for r in batches if r.key is None)


def test_null_keys_cannot_be_split(spark):
    df = spark.createDataFrame([(None, "a"), (1, "a"), (2, "a")], "key long, label string")
    with pytest.raises(Exception, match="NULL in split key"):
        rk.stratified_split(df, "key", "label", 42).collect()


def test_null_labels_are_a_stratum(spark):
    df = spark.range(100).select(F.col("id").alias("key"), F.when(F.col("id") < 60, F.lit("a")).when(F.col("id") < 80, F.lit("b")).alias("label"))
    sizes = {(r.label, r.split): r["count"] for r in rk.stratified_split(df, "key", "label", 42).groupBy("label", "split").count().collect()}
    assert sizes[(None, "test")] == 6 and sizes[(None, "val")] == 4 and sizes[(None, "train")] == 10
    kept = {r.label: r["count"] for r in rk.balanced_downsample(df, "key", "label", 42).groupBy("label").count().collect()}
    assert kept == {"a": 20, "b": 20, None: 20}


def test_outlier_position_does_not_gather_rows(spark):
    ids = spark.range(20_000).select("id").union(spark.createDataFrame([(1 << 50,)], "id long")).repartition(8)
    ranked = rk.range_rank(ids, "id", "rn")
    rows = {r.id: r.rn for r in ranked.collect()}
    assert rows[1 << 50] == 20_000 and all(rows[i] == i for i in range(20_000))


def test_ranks_of_one_script_are_spread(spark):
    from lexiframe.operators.features import vocabulary

    words = [chr(0x0915 + i % 30) + chr(0x093E) + chr(0x0915 + i // 30) for i in range(600)]
    tc = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, token string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.token: r.term_id for r in vocabulary(tc, "doc_id", with_ids=True).collect()}
        spread = vocabulary(tc, "doc_id").repartitionByRange("token").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [w for w, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(set(words), key=lambda w: w.encode())
    assert len(spread) > 4


def test_row_at_reads_keys_of_any_distribution(spark):
    df = spark.createDataFrame([(1 << 40, "far"), (3, "c"), (1, "a"), (2, "b")], "k long, v string")
    assert [rk.row_at(df, "k", i).first().v for i in range(4)] == ["a", "b", "c", "far"]
