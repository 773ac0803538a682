"""Rows that need not move for a join with a set of keys."""

from pyspark.sql import functions as F

from lexiframe.llm import presence, robust_rules
from lexiframe.llm.jaccard_groups import verified
from lexiframe.llm.storage import written
from tests.llm.helpers import documents, text


def moved(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_every_row_is_on_one_side_and_none_of_the_keys_is_lost(spark):
    rows = spark.createDataFrame([(i % 400 if i % 7 else None, f"t{i}") for i in range(1000)], "id long, `a.b` string")
    keys = written(spark.createDataFrame([(3,), (3,), (250,), (None,), (9999,)], "k long"), "keys")
    may, stay = presence.split_by(rows, F.col("id"), keys, "k")
    assert may.columns == stay.columns == rows.columns
    assert sorted(may.unionByName(stay).collect(), key=str) == sorted(rows.collect(), key=str)
    assert stay.filter("id in (3, 250)").isEmpty()
    assert may.filter("id is not null").select("id").distinct().count() < 20
    assert moved(stay) == moved(may) == 0


def test_a_full_bitmap_moves_more_rows_and_loses_none(spark, monkeypatch):
    monkeypatch.setattr(presence, "FEWEST", 1 << 6)
    monkeypatch.setattr(presence, "MOST", 1 << 6)
    rows = spark.range(2000).withColumnRenamed("id", "x")
    keys = written(spark.range(0, 2000, 3), "keys")
    may, stay = presence.split_by(rows, F.col("x"), keys, "id")
    assert stay.filter("x % 3 = 0").isEmpty()
    assert may.count() + stay.count() == 2000


def test_rows_that_no_rule_rejects_stay_where_they_are(spark):
    docs = documents(spark, [(i, text(i, 60)) for i in range(60)] + [(100, "few words"), (None, None)])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = robust_rules.quality_stage(spark, docs, None)
        assert left._jdf.queryExecution().optimizedPlan().toString().lstrip().startswith("Union")
        assert 100 not in {r.doc_id for r in left.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_only_texts_of_pairs_are_compared(spark, monkeypatch):
    seen = []
    whole = presence.split_by

    def watched(rows, key, keys, column):
        out = whole(rows, key, keys, column)
        seen.append(out[0].count())
        return out

    monkeypatch.setattr("lexiframe.llm.jaccard_groups.split_by", watched)
    docs = spark.createDataFrame([(i, text(i % 90, 60)) for i in range(100)], "id long, text string")
    pairs = written(spark.createDataFrame([(90, 0), (91, 1), (92, 50)], "node long, to long"), "pairs")
    assert {tuple(r) for r in verified(pairs, docs).collect()} == {(90, 0), (91, 1)}
    assert seen and seen[0] < 12
