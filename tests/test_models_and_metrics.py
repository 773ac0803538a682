"""Metrics, losses and naive Bayes against brute-force numpy versions."""

import math
from collections import Counter

import numpy as np
import pytest

from lexiframe.functions.vectors import argmax, log_softmax, logsumexp, softmax
from lexiframe.operators import contrastive as con
from lexiframe.operators import metrics as met
from lexiframe.operators import naive_bayes as nb
from lexiframe.operators.features import term_counts


def test_macro_f1_with_missing_classes(spark):
    # class c is never predicted, class d is never true
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("b", "d"), ("a", "a")]
    df = spark.createDataFrame(pairs, "label string, prediction string")
    ev = met.evaluate(df).first()
    classes = sorted({x for p in pairs for x in p})
    f1s = []
    for c in classes:
        tp = sum(1 for t, p in pairs if t == c and p == c)
        fp = sum(1 for t, p in pairs if t != c and p == c)
        fn = sum(1 for t, p in pairs if t == c and p != c)
        f1s.append(0.0 if 2 * tp + fp + fn == 0 else 2 * tp / (2 * tp + fp + fn))
    assert ev.macro_f1 == pytest.approx(sum(f1s) / len(f1s))
    assert ev.accuracy == pytest.approx(3 / 6)
    conf = {(r.label, r.prediction): r.n for r in met.confusion_long(df).collect()}
    assert len(conf) == 16 and conf[("c", "c")] == 0 and conf[("a", "a")] == 2


def test_softmax_argmax_ties_and_large_values(spark):
    rows = [([1.0, 3.0, 3.0],), ([1000.0, -1000.0, 999.0],)]
    df = spark.createDataFrame(rows, "v array<double>")
    out = df.select(argmax("v").alias("a"), softmax("v").alias("p"), logsumexp("v").alias("l"),
                    log_softmax("v").alias("ls")).collect()
    assert out[0].a == 1 and out[1].a == 0
    for r, (v,) in zip(out, rows):
        x = np.array(v)
        ref = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
        assert np.allclose(r.p, ref)
        assert r.l == pytest.approx(x.max() + np.log(np.exp(x - x.max()).sum()))
        assert all(math.isfinite(t) for t in r.ls)


def _supcon_ref(z, y, tau):
    z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    s = z @ z.T / tau
    n = len(y)
    losses = []
    for i in range(n):
        others = [k for k in range(n) if k != i]
        pos = [k for k in others if y[k] == y[i]]
        if not pos:
            losses.append(0.0)
            continue
        m = max(s[i, k] for k in others)
        lse = m + np.log(sum(np.exp(s[i, k] - m) for k in others))
        losses.append(-np.mean([s[i, j] - lse for j in pos]))
    return float(np.mean(losses))


def test_supcon_loss_matches_numpy(spark):
    rng = np.random.default_rng(0)
    rows, batches = [], {0: 6, 1: 1, 2: 4}
    pos = 0
    for b, size in batches.items():
        for _ in range(size):
            rows.append((b, pos, int(rng.integers(0, 3)), rng.normal(size=5).tolist()))
            pos += 1
    df = spark.createDataFrame(rows, "batch long, pos long, label int, v array<double>")
    got = {r.batch: r.loss for r in con.supcon_loss(df, "batch", "pos", "label", "v", 0.1).collect()}
    for b in batches:
        sub = [r for r in rows if r[0] == b]
        ref = _supcon_ref(np.array([r[3] for r in sub]), [r[2] for r in sub], 0.1)
        assert got[b] == pytest.approx(ref, rel=1e-9, abs=1e-9)
    assert got[1] == 0.0


def test_naive_bayes_matches_brute_force(spark):
    train = [(0, "cheap pills cheap offer", "spam"), (1, "meeting agenda notes", "ham"),
             (2, "cheap offer now", "spam"), (3, "project meeting today", "ham"), (4, "hello", "ham")]
    test = [(10, "cheap meeting offer"), (11, "unknown words only"), (12, "agenda agenda cheap")]
    tr = spark.createDataFrame(train, "doc_id long, text string, label string")
    te = spark.createDataFrame(test, "doc_id long, text string")
    model = nb.fit_naive_bayes(term_counts(tr, "doc_id"), tr.select("doc_id", "label"), "doc_id", "label")
    got = {r.doc_id: r.prediction for r in
           nb.predict_naive_bayes(model, term_counts(te, "doc_id"), te.select("doc_id"), "doc_id").collect()}
    vocab = sorted({t for _, s, _ in train for t in s.split() if len(t) >= 2})
    classes = sorted({c for *_, c in train})
    counts = {c: Counter() for c in classes}
    for _, s, c in train:
        counts[c].update(t for t in s.split() if len(t) >= 2)
    n = len(train)
    for doc_id, s in test:
        x = Counter(t for t in s.split() if t in vocab)
        best = None
        for c in classes:
            nc = sum(1 for *_, cc in train if cc == c)
            tot = sum(counts[c].values())
            score = math.log(nc / n) + sum(v * math.log((counts[c][t] + 1) / (tot + len(vocab))) for t, v in x.items())
            if best is None or score > best[0]:
                best = (score, c)
        assert got[doc_id] == best[1], doc_id
    # a document without known terms gets the class with the larger prior
    assert got[11] == "ham"


def test_step_epoch_grouping(spark):
    df = spark.createDataFrame([("r", 0, 1, 1), ("r", 0, 1, 0), ("r", 1, 2, 2)],
                               "run string, batch int, label int, prediction int")
    rows = {(r.grain, r.batch): r.accuracy for r in met.step_and_epoch(df, "run", "batch").collect()}
    assert rows[("step", 0)] == 0.5 and rows[("step", 1)] == 1.0
    assert rows[("epoch", None)] == pytest.approx(2 / 3)


def test_naive_bayes_save_load_round_trip(spark, tmp_dir):
    import os
    tr = spark.createDataFrame([(0, "alpha beta beta", "x"), (1, "gamma delta", "y"), (2, "beta alpha", "x")],
                               "doc_id long, text string, label string")
    te = spark.createDataFrame([(5, "beta gamma"), (6, "delta delta")], "doc_id long, text string")
    model = nb.fit_naive_bayes(term_counts(tr, "doc_id"), tr.select("doc_id", "label"), "doc_id", "label")
    path = os.path.join(tmp_dir, "nb")
    model.save(path)
    loaded = nb.NaiveBayesModel.load(spark, path)
    a = {r.doc_id: r.prediction for r in
         nb.predict_naive_bayes(model, term_counts(te, "doc_id"), te.select("doc_id"), "doc_id").collect()}
    b = {r.doc_id: r.prediction for r in
         nb.predict_naive_bayes(loaded, term_counts(te, "doc_id"), te.select("doc_id"), "doc_id").collect()}
    assert a == b == {5: "x", 6: "y"}


def test_metrics_beside_the_write_read_nothing_again(spark, tmp_dir):
    """Observed counts equal the grouped ones, zero cells and classes without rows included."""
    from lexiframe.operators import metrics as met

    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("a", "a")]
    df = spark.createDataFrame(rows, "label string, prediction string")
    written, grid = met.write_with_metrics(df, f"{tmp_dir}/p", ["c", "a", "b", "d"])
    assert sorted(map(tuple, written.collect())) == sorted(rows)
    assert {(r.label, r.prediction): r.n for r in grid.collect()} == {(x, y): rows.count((x, y)) for x in "abcd" for y in "abcd"}
    assert met.metrics_of(grid).first() == met.evaluate(df).first()
    with pytest.raises(ValueError, match="not named"):
        met.write_with_metrics(df, f"{tmp_dir}/q", ["a", "b"])
