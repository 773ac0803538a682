"""Many blocks of rows with many terms: few rounds on the rows that decide the fit."""

import random

import numpy as np

from lexiframe.operators import svm, svm_newton, svm_working_set
from tests.test_svm import fitted


def wide_table(n=200, classes=3):
    """Common words of each class, noise of all and a rare word per row; some rows under a wrong label."""
    rnd = random.Random(3)
    docs, features = [], []
    for i in range(n):
        c = rnd.randrange(classes)
        words = {f"c{c}-{rnd.randrange(30)}" for _ in range(10)} | {f"n{rnd.randrange(200)}" for _ in range(10)} | {f"r{i}"}
        docs.append((i, "abcdef"[rnd.randrange(classes) if i % 40 == 0 else c]))
        features += [(i, w, float(rnd.randrange(1, 4))) for w in sorted(words)]
    return docs, features


def test_many_blocks_of_many_terms_need_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(svm_newton, "MATRIX_VALUES", 8)
    docs, features = wide_table()
    _, _, rows, model = fitted(spark, docs, features, block_values=3000, rounds=6)
    assert rows.count() > 3000
    proof = svm.certificate(rows, model).first()
    assert proof.feasible and proof.gap <= 0.01 + 1e-9 and max(model.gaps) <= 0.01


def test_repeated_pairs_are_one_value():
    import pyarrow as pa

    table = pa.table({"row": ["b", "a", "b", "a"], "term": ["y", "x", "y", ""], "value": [1.0, 2.0, 3.0, 1.0]})
    names, terms, starts, code, value, first = svm_working_set._by_row(table)
    assert names.to_pylist() == ["a", "b"] and [terms[i].as_py() for i in code.tolist()] == ["", "x", "y"]
    assert starts.tolist() == [0, 2, 3] and value.tolist() == [1.0, 2.0, 4.0] and first.tolist() == [3, 0]


def test_ascent_reaches_the_optimum_of_two_rows():
    """Rows (1) and (-1) of either class: w = 1, both dual variables one half."""
    w, alpha = np.zeros(1), np.zeros(2)
    svm_working_set.ascend(w, alpha, np.array([1.0, -1.0]), np.array([0, 1, 2]), np.zeros(2, np.int64), np.array([1.0, -1.0]), 1.0, 20, 0, 1e-9)
    assert abs(w[0] - 1) < 1e-9 and abs(alpha.sum() - 1) < 1e-9
