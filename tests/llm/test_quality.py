"""Quality rules and weak-label classifier: counts and estimates against plain
Python, planted junk and held-out labels."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiframe.llm import robust_rules as rr
from lexiframe.llm import weak_labels as wl
from lexiframe.llm.storage import written
from tests.conftest import SF_SMALL
from tests.llm.helpers import WORD, clashing, documents, saved, text

SF_MID = "/root/testdata/sf0.01"


def _counts(t):
    w = WORD.findall(t or "")
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    often, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \n\t", "one", "a b c d e a b c d e", "x " * 30, "é# ü*\x0bword\x0cword\r\n\n \nsame\nsame\n same",
         "l1 l1\nl1 l1\nl1 l1", "a b c d e f " * 3 + "g h i j k", text(1, 25_000, 50), "\U0001f600 \U0001f600<>&|"]


def test_counts_equal_plain_python(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one"), (None, "one two")]
    docs = clashing(documents(spark, rows))
    got = rr.with_verdicts(docs, [F.col("doc_id")]).select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = []
    for i, t in rows:
        c = _counts(t)
        want.append((i, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(want, key=key)
    assert not any(r.kept and r.base_failed for r in got)


def _estimate(x):
    """The same deterministic estimate in numpy: concentration from both starts, smallest determinant."""
    floors = np.array(list(rr.FLOORS.values()))
    x = x / rr.GRID
    best = None

    def scatter(rows):
        return rows.mean(axis=0), np.cov(rows.T, bias=True).reshape(len(floors), -1) * rr.CONSISTENCY + np.diag(floors ** 2)

    def distance(c, s):
        d = x - c
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d)

    median = np.median(x, axis=0)
    for c, s in (scatter(x), (median, np.diag((1.4826 * np.median(np.abs(x - median), axis=0)) ** 2 + floors ** 2))):
        for _ in range(rr.STEPS):
            cls = np.floor(rr.CLASSES * np.log2(distance(c, s) + 1e-6))
            cut = np.sort(cls)[int(np.ceil(rr.SUBSET * len(x))) - 1]
            c, s = scatter(x[cls <= cut])
        det = np.linalg.slogdet(s)[1]
        if best is None or det < best[0] - 1e-12:
            best = (det, distance(c, s))
    return best[1]


def test_estimate_equals_numpy(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    counted = written(rr.with_rates(rr.with_counts(docs, "text", [F.col(c) for c in ("doc_id", "lang", "source")])), "counts")
    rated = rr.with_groups(counted, "lang", "source")
    rows = rated.filter("not base_failed").select("doc_id", "_group", *rr.X).toPandas()
    got = {r.doc_id: r.distance for r in rr.with_verdicts(docs, [F.col("doc_id")]).select("_row.doc_id", "distance").collect() if r.distance is not None}
    groups = [g for g in rows["_group"].unique() if g is not None]
    assert groups
    for g in groups:
        mine = rows[rows["_group"] == g]
        want = _estimate(mine[rr.X].to_numpy(dtype=float))
        np.testing.assert_allclose([got[i] for i in mine["doc_id"]], want, rtol=1e-6, atol=1e-9)


def test_clean_documents_stay_and_junk_goes(spark):
    rnd = random.Random(5)
    clean = [(i, " ".join(rnd.choice(["of", "the"]) if rnd.random() < .4 else f"{rnd.choice('abcdefgh') * rnd.randint(2, 8)}{rnd.randint(0, 99)}" for _ in range(rnd.randint(12, 400)))) for i in range(300)]
    junk = [(1000 + i, " ".join(w + "***" for w in t.split())) for i, t in clean[:25]]
    got = {r.doc_id: r.kept for r in rr.op2_robust_rules(spark, _folder(spark, clean + junk)).collect()}
    assert not any(got[i] for i, _ in junk)
    assert sum(got[i] for i, _ in clean) >= 0.995 * sum(_counts(t)[4] == 0 for _, t in clean)


def _folder(spark, rows):
    import tempfile

    return saved(documents(spark, rows), tempfile.mkdtemp(prefix="lexiframe-test-"))


def test_result_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    a, b = ({r.doc_id: (r.kept, r.distance) for r in rr.with_verdicts(d, [F.col("doc_id")]).select("_row.doc_id", "kept", "distance").collect()}
            for d in (docs.repartition(1), docs.repartition(9)))
    assert {k: v[0] for k, v in a.items()} == {k: v[0] for k, v in b.items()}
    assert all(v[1] == b[k][1] or abs(v[1] - b[k][1]) < 1e-9 * max(1, v[1]) for k, v in a.items())


def test_stage_keeps_columns(spark):
    docs = clashing(documents(spark, [(1, "a b"), (2, text(4, 60)), (3, None), (None, text(5, 60))]))
    out = rr.quality_stage(spark, docs, "")
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["2", "None"]
    assert rr.quality_stage(spark, documents(spark, []), "").count() == 0


def test_groups_are_pooled_and_null_safe(spark):
    rows = [(i, None, False) for i in range(70)] + [(100 + i, "a", False) for i in range(30)] + [(200 + i, "b", False) for i in range(31)] + [(300, "c", True)]
    df = spark.createDataFrame(rows, "doc_id long, source string, base_failed boolean").withColumn("lang", F.lit("en"))
    got = {r.doc_id: r._group for r in rr.with_groups(df, "lang", "source").collect()}
    assert got[0] is not None and got[0] != got[100] == got[230] and got[300] is None


def test_em_recovers_accuracies():
    rnd = np.random.default_rng(3)
    n = 40_000
    y = rnd.random(n) < 0.85
    accuracy = np.array([[0.9, 0.97], [0.8, 0.95], [0.7, 0.99], [0.95, 0.96]])  # bad, good
    votes = np.array([["0" if v == 0 else "1" for v in np.where(rnd.random(n) < np.where(y, a[1], a[0]), y, ~y).astype(int)] for a in accuracy]).T
    counts = Counter("".join(v) for v in votes)
    posterior, model = wl.estimate(list(counts.items()))
    assert abs(model["prior"] - 0.85) < 0.02
    for i, a in enumerate(accuracy):
        assert abs(model["chances"][i, 0, 0] - a[0]) < 0.05 and abs(model["chances"][i, 1, 2] - a[1]) < 0.02
    hit = np.mean([(posterior["".join(v)] >= 0.5) == t for v, t in zip(votes, y)])
    assert hit > 0.96
    assert wl.estimate([])[0] == {}


def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    got = wl.op1_weak_label_quality(spark, SF_MID)
    assert got.count() == 1000
    rows = got.join(labels, "doc_id").select("quality", "kept").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (2, ""), (None, "a b c"), (3, text(2, 30_000))]])
def test_classifier_edges(spark, tmp_dir, rows):
    got = wl.op1_weak_label_quality(spark, saved(clashing(documents(spark, rows)), tmp_dir)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert all(0 <= r.score <= 1 for r in got) and not any(r.kept for r in got if r.n_words == 0)
