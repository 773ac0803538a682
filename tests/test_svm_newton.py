"""Many blocks of rows with few terms: Newton steps, proved by the certificate."""

from lexiframe.operators import svm, svm_newton
from tests.test_svm import fitted, table_of


def test_many_blocks_of_few_terms_need_few_rounds(spark):
    docs, features = table_of(11, n=60)
    _, _, rows, model = fitted(spark, docs, features, block_values=60, tolerance=0.03, rounds=40)
    proof = svm.certificate(rows, model).first()
    assert proof.feasible and proof.gap <= 0.03 + 1e-9
    assert model.weights.count() == rows.select("term").distinct().count()


def test_many_terms_still_meet_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(svm_newton, "MATRIX_VALUES", 8)
    docs, features = table_of(4, n=40)
    _, _, rows, model = fitted(spark, docs, features, block_values=150, tolerance=0.5)
    assert svm_newton.few_terms(rows, 3) is None
    assert svm.certificate(rows, model).first().gap <= 0.5 + 1e-9


def test_a_fit_by_newton_steps_is_saved_with_its_gaps(spark, tmp_dir):
    docs, features = table_of(11, n=60)
    d, f, rows, model = fitted(spark, docs, features, block_values=60, tolerance=0.03, rounds=40)
    model.save(f"{tmp_dir}/m")
    back = svm.LinearModel.load(spark, f"{tmp_dir}/m")
    assert back.gaps == model.gaps and max(back.gaps) <= 0.03
    before, after = (svm.predict_svm(m, f, d, "id", "v").collect() for m in (model, back))
    assert sorted(before) == sorted(after)
