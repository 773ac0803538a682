"""Feature maps against exact kernels, the fitted machine against an exact kernel solver, saving."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiframe.operators import kernel_maps as km
from lexiframe.operators import svm


def corpus(seed, n=70):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        c = rnd.randrange(3)
        rows.append((i, " ".join(f"w{rnd.randrange(c * 9, c * 9 + 16)}" for _ in range(rnd.randrange(0, 14))), "xyz"[c]))
    return rows


def exact(rows, gamma):
    bags = [Counter(re.findall(r"\w\w+", t)) for _, t, _ in rows]
    words = sorted(set().union(*bags))
    x = np.array([[b[w] for w in words] for b in bags], dtype=float)
    g = 1 / (x.shape[1] * x.var()) if gamma == "scale" else gamma
    return np.exp(-g * ((x[:, None] - x[None]) ** 2).sum(-1)), g


def images(spark, model, rows):
    d = spark.createDataFrame(rows, "id long, text string, label string")
    out = {}
    for r in model.features(d, "id", "text").collect():
        out.setdefault(r["id"], {})[int(r["token"])] = r["value"]
    return np.array([[out[i][j] for j in range(len(out[i]))] for i in sorted(out)])


@pytest.mark.parametrize("kind,width", [("landmarks", 70), ("landmarks", 40), ("fourier", 2000)])
def test_images_stand_for_the_kernel(spark, kind, width):
    """Landmarks: exact for every pair with a landmark, never above the kernel
    elsewhere (the rest is positive semi-definite); Fourier features: everywhere
    to about 1 / sqrt(width)."""
    rows = corpus(1)
    kernel, gamma = exact(rows, "scale")
    d = spark.createDataFrame(rows, "id long, text string, label string")
    packed = km.packed_rows(d, "id", "text").cache()
    assert np.isclose(km.scale_gamma(packed), gamma)
    fitted = km.choose_landmarks(packed, "id", width, gamma, 1) if kind == "landmarks" else km.FourierFeatures(width, gamma, 1)
    z = images(spark, km.KernelModel(kind, fitted, None, None), rows)
    rest = kernel - z @ z.T
    if kind == "fourier":
        assert np.abs(rest).max() < 0.12
    else:
        assert (np.abs(rest).max(axis=0) < 1e-6).sum() >= width and np.linalg.eigvalsh(rest).min() > -1e-6


def exact_votes(kernel, label, c=1.0):
    """One against one on the exact kernel plus one (the bias), by dual coordinate ascent."""
    votes = np.zeros((len(label), 3))
    k = kernel + 1
    for a, b in svm.combinations(range(3), 2):
        at = np.flatnonzero((label == a) | (label == b))
        y = np.where(label[at] == a, 1.0, -1.0)
        q, alpha = k[np.ix_(at, at)] * np.outer(y, y), np.zeros(len(at))
        for _ in range(3000):
            for i in range(len(at)):
                alpha[i] = min(c, max(0.0, alpha[i] + (1 - q[i] @ alpha) / q[i, i]))
        m = k[:, at] @ (alpha * y)
        votes[m >= 0, a] += 1
        votes[m < 0, b] += 1
    return votes.argmax(axis=1)


def test_machine_agrees_with_the_exact_kernel_and_survives_saving(spark, tmp_dir):
    rows = corpus(2)
    kernel, _ = exact(rows, "scale")
    want = exact_votes(kernel, np.array(["xyz".index(r[2]) for r in rows]))
    d = spark.createDataFrame(rows, "id long, text string, label string")
    model, trained = km.fit_kernel_svm(d, "id", "text", "label", width=60)
    assert svm.certificate(trained, model.linear).first().gap <= 0.01 + 1e-9
    got = {r["id"]: r["prediction"] for r in model.predict(d, "id", "text").collect()}
    assert np.mean([got[i] == "xyz"[want[i]] for i in range(len(rows))]) >= 0.95
    model.save(f"{tmp_dir}/k")
    back = km.KernelModel.load(spark, f"{tmp_dir}/k")
    assert {r["id"]: r["prediction"] for r in back.predict(d, "id", "text").collect()} == got


def test_long_and_empty_rows_are_no_landmarks_but_are_mapped(spark):
    rows = [(1, "", "x"), (2, " ".join(f"w{i}" for i in range(km.LONGEST + 5)), "y"), (3, "one two", "y"), (4, None, "x")]
    d = spark.createDataFrame(rows, "id long, text string, label string")
    packed = km.packed_rows(d, "id", "text")
    marks = km.choose_landmarks(packed, "id", 10, 0.5, 1)
    assert len(marks.square) == 3
    z = images(spark, km.KernelModel("landmarks", marks, None, None), rows)
    assert z.shape == (4, 3) and np.isfinite(z).all()


def _bags(packed):
    return {r["id"]: {i: round(v, 12) for i, v in zip(r["ids"], r["values"], strict=True)} for r in packed.collect()}


@pytest.mark.parametrize("shipped", [1000, 9, 0])
def test_weights_are_the_same_whatever_part_of_the_terms_is_shipped(spark, monkeypatch, shipped):
    rows = [(r[0], r[1]) for r in corpus(3)] + [(100, None), (101, "nowhere else"), (102, "Ab ab AB w1")]
    d = spark.createDataFrame(rows, "id long, text string")
    idf = km.idf_table(d.filter("id <> 101"), "text")
    want = {}
    for r in km.tfidf(km.term_counts(d, "id", "text"), idf, "id").select("id", F.xxhash64("token").alias("t"), "weight").collect():
        want.setdefault(r["id"], {})[r["t"]] = round(r["weight"], 12)
    monkeypatch.setattr(km, "SHIPPED_TERMS", shipped)
    packed = km.packed_rows(d, "id", "text", idf)
    assert _bags(packed) == {i: want.get(i, {}) for i, _ in rows}
    if shipped == 1000:  # nothing but texts is read
        assert "Exchange" not in packed._jdf.queryExecution().executedPlan().toString()


def test_rows_that_share_a_key_share_their_weighted_terms(spark):
    d = spark.createDataFrame([(1, "one two"), (1, "two three"), (2, "one"), (None, "two")], "id long, text string")
    got = [(r["id"], len(r["ids"])) for r in km.packed_rows(d, "id", "text", km.idf_table(d, "text")).collect()]
    assert sorted(got, key=str) == [(1, 3), (1, 3), (2, 1), (None, 0)]
    assert sorted(len(r["ids"]) for r in km.packed_rows(d, "id", "text").collect()) == [1, 1, 2, 2]


def test_images_reach_the_fit_as_one_row_per_document(spark):
    """Newton steps on images: no row per component, proved by the certificate, predictions as in long form."""
    rows = corpus(5)
    d = spark.createDataFrame(rows, "id long, text string, label string")
    model, trained = km.fit_kernel_svm(d, "id", "text", "label", kind="fourier", width=20, gamma=0.2, against="rest", block_values=300)
    assert trained.count() == len(rows) and model.linear.weights.count() == 21
    proof = svm.certificate(trained, model.linear).first()
    long = svm.certificate(svm.long_rows(trained), model.linear).first()
    assert proof.feasible and proof.gap <= 0.01 + 1e-9 and np.isclose(proof.gap, long.gap)
    by_term = svm.predict_svm(model.linear, model.features(d, "id", "text"), d.select("id"), "id", "value")
    assert sorted(by_term.collect()) == sorted(model.predict(d, "id", "text").collect())


def test_rows_of_one_key_are_added(spark):
    images = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 5.0]), (2, [1.0, 1.0]), (None, [9.0, 9.0])], "id long, v array<double>")
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None), (None, "b")], "id long, label string")
    dense, classes = svm.training_rows(images, docs, "id", "label", "v")
    long, _ = svm.training_rows(images.select("id", F.posexplode("v").alias("token", "w")).withColumn("token", F.col("token").cast("string")), docs, "id", "label", "w")

    def sums(rows):
        return sorted((str(r["row"]), r["class"], r["term"], r["v"]) for r in rows.groupBy("row", "class", "term").agg(F.sum("value").alias("v")).collect())

    assert classes == ["a", "b"] and sums(svm.long_rows(dense)) == sums(long)


def test_directions_are_normal_numbers_of_the_term_alone(spark):
    f = km.FourierFeatures(101, 0.5, 3)
    w = f.directions(np.arange(4000) * 7919)
    assert np.array_equal(w[5:9], f.directions(np.arange(5, 9) * 7919))
    assert abs(w.mean()) < 0.01 and abs(w.std() - 1) < 0.01 and abs(np.corrcoef(w[:, 0], w[:, 51])[0, 1]) < 0.06
    assert abs((w ** 4).mean() - 3) < 0.1 and (np.abs(w) > 3).mean() < 0.004
