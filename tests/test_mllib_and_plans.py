"""Floor tests for the MLlib models and plan-shape checks for scale."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from lexiframe.operators import ranking as rk
from tests.conftest import SF_SMALL

SF_MID = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["linear_svm", "svm_tfidf"])
def test_svm_beats_majority(spark, name):
    row = E.queries()[name](spark, SF_MID).first()
    assert row.n > 0 and row.beats_majority and row.gap_within_percent


def test_linear_probe_is_optimal_and_survives_saving(spark):
    row = E.queries()["linear_probe"](spark, SF_SMALL).first()
    assert row.loss_below_guessing and row.gradient_near_zero
    assert all(r.same for r in E.queries()["model_round_trip"](spark, SF_SMALL).collect())


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_stratified_split_does_not_shuffle_rows(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", F.col("lang").alias("label"), "text")
    plan = _plan(rk.stratified_split(docs, "doc_id", "label", 42))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize("name", ["first_n", "class_sizes", "term_counts", "mean_word_count", "head_per_label"])
def test_no_round_robin(spark, name):
    assert "RoundRobin" not in _plan(E.queries()[name](spark, SF_SMALL))


def test_batch_loss_needs_one_exchange_after_ranking(spark):
    from lexiframe.operators import contrastive as con

    df = spark.range(40).select((F.col("id") % 4).alias("b"), "id", (F.col("id") % 3).alias("y"), F.array(F.lit(1.0), F.col("id") * 0.1).alias("v"))
    plan = _plan(con.supcon_loss(df, "b", "id", "y", "v")).split("Initial Plan")[0]
    assert plan.count("hashpartitioning") == 1 and "Join" not in plan


def test_filter_reaches_scan(spark):
    df = E.queries()["filter_isin"](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), In(lang, [en,fr])]" in plan or "In(lang, [en,fr])" in plan


def test_tfidf_of_gathered_documents_has_one_exchange_of_rows(spark):
    from lexiframe.operators import features as feat
    from lexiframe.plans.common import SplitFeatures

    sf = SplitFeatures(spark, SF_SMALL)
    idf = F.broadcast(feat.idf_table(sf.docs_of("train")))
    plain, gathered = (feat.tfidf(sf.tc("test", gathered=g), idf, "doc_id") for g in (False, True))
    exchanges = [w._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for w in (plain, gathered)]
    assert exchanges[1] == 1 < exchanges[0]
    rows = [{(r.doc_id, r.token): (r.tf, round(r.weight, 9)) for r in w.collect()} for w in (plain, gathered)]
    assert rows[0] == rows[1]
