"""Plug-in tokenizer seam and split-partitioned storage with partition pruning."""

import os

from pyspark.sql import functions as F

from lexiframe.operators import batching as bt
from lexiframe.operators import ranking as rk
from lexiframe.sinks.writers import write_table
from tests.conftest import SF_SMALL


def test_tokenize_with_plugin(spark):
    # defined inside the test so it is shipped to workers by value
    def _toy_tokenizer():
        vocab = {}

        def encode(texts):
            return [[vocab.setdefault(w, len(vocab) + 2) for w in t.split()] for t in texts]

        return encode

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    out = bt.tokenize_with(docs, "text", _toy_tokenizer, max_length=16).collect()
    assert all(len(r.input_ids) == min(16, len(r.text.split())) for r in out)


def test_stage_selection_prunes_partitions(spark, tmp_dir):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", F.col("lang").alias("label"))
    path = os.path.join(tmp_dir, "splits")
    write_table(rk.stratified_split(docs, "doc_id", "label", 42), path, partition_by=["split"])
    fit = rk.select_stage(spark.read.parquet(path), "fit")
    plan = fit._jdf.queryExecution().executedPlan().toString()
    part_filters = plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "split" in part_filters
    n = fit.count()
    assert n == docs.count() - rk.select_stage(spark.read.parquet(path), "test").count()
