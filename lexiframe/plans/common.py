"""Shared plan pieces: table loading and the standard document split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.operators.features import term_counts
from lexiframe.operators.ranking import stratified_split
from lexiframe.operators.tables import wide_by_position

# The seed and split ratios of the reference's dataset notebooks
# (test 30 %, then validation 2/7 of the rest -> 50/20/30).
SEED = 42
TEST_SIZE = 0.3
VAL_SIZE = 2 / 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def doc_split(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """``(doc_id, label, split[, text])``: documents' language as a 4-class
    label, stratified 50/20/30 by the seeded md5 order.  The split is decided
    row by row against per-label boundaries, so the text is not shuffled."""
    cols = ["doc_id", F.col("lang").alias("label")] + (["text"] if with_text else [])
    docs = documents(spark, sf_dir).select(*cols)
    return stratified_split(docs, "doc_id", "label", SEED, TEST_SIZE, VAL_SIZE)


class SplitFeatures:
    """Term counts of the train and test documents, each document tokenised
    once on its own side of the split."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.docs = doc_split(spark, sf_dir, with_text=True)
        self.split = self.docs.select("doc_id", "label", "split")

    def docs_of(self, name: str) -> DataFrame:
        return self.docs.filter(F.col("split") == name)

    def labels_of(self, name: str) -> DataFrame:
        return self.split.filter(F.col("split") == name).select("doc_id", "label")

    def tc(self, name: str, with_label: bool = False, gathered: bool = False) -> DataFrame:
        """``gathered``: the texts are exchanged by document before they are tokenised
        (each much smaller than its counts), so that counts, norms and sums per
        document need no exchange of their own while terms are joined by broadcast."""
        docs = self.docs_of(name)
        return term_counts(docs.repartition("doc_id") if gathered else docs, "doc_id", "text", carry=["label"] if with_label else [])

    def n_docs(self, name: str):
        return self.split.filter(F.col("split") == name).select(F.count(F.lit(1))).scalar()


def quote_table(spark: SparkSession, sf_dir: str, n_quotes: int = 10) -> DataFrame:
    """Conversations pivoted by turn: ``conv_id, quote_1 .. quote_10`` (NULL where
    a conversation has fewer turns), standing in for a ten-quote workbook."""
    conv = table(spark, sf_dir, "conversations")
    return wide_by_position(conv, "conv_id", "turn", "text", list(range(n_quotes)), "_q").toDF(
        "conv_id", *[f"quote_{i}" for i in range(1, n_quotes + 1)])
