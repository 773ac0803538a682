"""Augmentation properties, padded batches, translation seam and the metric stream."""

import os
from collections import Counter


from lexiframe.operators import augment as aug
from lexiframe.operators import batching as bt
from lexiframe.operators import ranking as rk
from lexiframe.streaming.metric_stream import best_checkpoints, start_metric_log
from tests.conftest import SF_SMALL


def _docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")


def test_swap_keeps_multiset_and_delete_removes_n(spark):
    docs = aug.swap_and_delete(_docs(spark), "text", "doc_id", "sw", "de", 42)
    for r in docs.collect():
        words = r.text.split()
        assert Counter(r.sw.split()) == Counter(words)
        n = max(1, int(0.3 * len(words))) if words else 0
        assert len(r.de.split()) == len(words) - n
    again = aug.swap_and_delete(_docs(spark).repartition(7), "text", "doc_id", "sw", "de", 42)
    a = {r.doc_id: (r.sw, r.de) for r in docs.collect()}
    b = {r.doc_id: (r.sw, r.de) for r in again.collect()}
    assert a == b


def test_pick_skips_nulls(spark):
    df = spark.createDataFrame([(1, None, "x", None), (2, None, None, None), (3, "a", "b", "c")],
                               "k long, a string, b string, c string")
    got = {r.k: r.p for r in df.select("k", aug.pick_one(["a", "b", "c"], "k").alias("p")).collect()}
    assert got[1] == "x" and got[2] is None and got[3] in {"a", "b", "c"}


def test_padded_batches_are_rectangular(spark):
    rows = [(i, list(range(i % 7 + 1))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, input_ids array<int>")
    b = rk.assign_batches(df, "doc_id", 4)
    out = bt.pad_batches(b, "batch_id", "input_ids", max_length=5).collect()
    by_batch = {}
    for r in out:
        by_batch.setdefault(r.batch_id, set()).add(len(r.input_ids))
        assert len(r.attention_mask) == len(r.input_ids)
        assert sum(r.attention_mask) == min(5, r.doc_id % 7 + 1)
    assert all(len(v) == 1 for v in by_batch.values())


def test_translate_wide_chunks(spark):
    calls = []

    def translator(texts, lang):
        calls.append(len(texts))
        return [lang + ":" + t for t in texts]

    out = aug.translate_wide(_docs(spark), "text", ["tl", "vi"], translator, chunk=32)
    rows = out.collect()
    assert all(r.augmented_tl == "tl:" + r.text and r.augmented_vi == "vi:" + r.text for r in rows)
    assert len(rows) == _docs(spark).count()


def test_translate_keeps_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], "k long, text string, label string")

    def translator(texts, lang):
        assert None not in texts
        return [lang + t for t in texts]

    got = {r.k: (r.label, r.augmented_tl) for r in aug.translate_wide(df, "text", ["tl"], translator).collect()}
    assert got == {1: ("x", "tla"), 2: ("y", None)}


def test_metric_stream_and_best(spark, tmp_dir):
    src, table, ckpt = (os.path.join(tmp_dir, p) for p in ("src", "table", "ckpt"))
    log = spark.createDataFrame(
        [("r1", "val", s, s // 10, "val_accuracy", v) for s, v in [(1, 0.5), (2, 0.7), (3, 0.6), (4, 0.65)]],
        "run string, split string, step long, epoch long, metric string, value double")
    log.write.parquet(src)
    q = start_metric_log(spark, src, table, ckpt)
    q.awaitTermination(120)
    best = {(r.kind, r.rank): r.step for r in best_checkpoints(spark, table, "val_accuracy", k=2).collect()}
    assert best == {("top", 1): 2, ("top", 2): 4, ("last", 0): 4}
