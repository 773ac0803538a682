"""Bag-of-words features as long tables: term counts, vocabulary, TF-IDF.

Long form ``(key, token, tf)`` keeps everything relational: counts come from
``explode`` + a grouped count whose partial aggregate collapses each
document's tokens inside the task that read it, so only distinct
(document, token) pairs cross the shuffle.  Document frequency and the
vocabulary are grouped by token; hot tokens are pre-aggregated per task
before the exchange, so a token found in every document costs one row per
task, not one per document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiframe.functions.text import whitespace_tokens, word_count, word_tokens
from lexiframe.operators.ranking import range_rank
from lexiframe.session import cut_lineage


def tokenize(df: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    return df.withColumn(out, word_tokens(text))


def token_count(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Per row: number of bag-of-words tokens and of whitespace words."""
    return df.select(key, F.size(word_tokens(text)).alias("n_tokens"), word_count(text).alias("n_words"))


def mean_word_count(df: DataFrame, text: str = "text") -> DataFrame:
    return df.agg(F.avg(word_count(text)).alias("mean_words"), F.count(F.lit(1)).alias("n_rows"))


def term_counts(df: DataFrame, key: str, text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """``(key, [carry...], token, tf)``: occurrences of each token in each
    row's whole text.  ``carry`` columns (for example the label) are constant
    per row and ride along, so no join is needed to get them back."""
    carry = list(carry)
    tokens = df.select(key, *carry, F.explode(word_tokens(text)).alias("token"))
    return tokens.groupBy(key, *carry, "token").agg(F.count(F.lit(1)).alias("tf"))


def occurrences(df: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``(keep..., token, tf = 1)``: one row per occurrence, for sums that need no
    counts per document (class sums, scores): no exchange by (document, token)."""
    return df.select(*keep, F.explode(word_tokens(text)).alias("token"), F.lit(1).alias("tf"))


def document_frequency(df: DataFrame, text: str = "text") -> DataFrame:
    """``(token, df)`` straight from the texts: each document's distinct tokens
    are found inside its row, so only tokens are exchanged."""
    return df.select(F.explode(F.array_distinct(word_tokens(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(tc: DataFrame, key: str, with_ids: bool = False) -> DataFrame:
    """``(token, df[, term_id])`` from term counts; ``term_id`` by sorted token.

    Ids are dense ranks in binary string order by range partitioning, so that
    a vocabulary in one script is spread like any other (runs a job).
    """
    # Term-count rows are unique per (key, token): a plain count is the
    # document frequency (no distinct aggregation needed).
    vocab = tc.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return with_term_ids(vocab) if with_ids else vocab


def with_term_ids(vocab: DataFrame) -> DataFrame:
    """Add ``term_id``: the place of each token in binary string order."""
    ranked = range_rank(vocab, "token", out="term_id")
    return ranked.withColumn("term_id", F.col("term_id").cast("int"))


def known_terms(tc: DataFrame, vocab: DataFrame) -> DataFrame:
    """Keep only tokens of a fitted vocabulary (unseen terms are ignored)."""
    return tc.join(vocab.select("token"), "token", "left_semi")


def idf_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(token, idf)`` with ``idf = ln((1+n)/(1+df)) + 1`` (smoothed, +1), of the
    given documents.  Fitting runs a job: the table is written once."""
    n = docs.select(F.count(F.lit(1))).scalar()
    idf = document_frequency(docs, text).select("token", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    return cut_lineage(idf, "idf")


def tfidf(tc: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """``(key, token, tf, weight)``: tf*idf, L2-normalised per row.

    Tokens missing from ``idf`` are dropped (as a fitted vectoriser does).  The
    idf table joins without a hint: AQE broadcasts it when the vocabulary is
    small and splits skewed token partitions when it is not.
    """
    w = tc.join(idf, "token", "inner").withColumn("_lf_w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_lf_w") * F.col("_lf_w")).over(Window.partitionBy(key)))
    return w.select(*tc.columns, (F.col("_lf_w") / norm).alias("weight"))


__all__ = [
    "tokenize", "token_count", "mean_word_count", "term_counts", "vocabulary", "known_terms",
    "idf_table", "tfidf", "whitespace_tokens", "occurrences", "document_frequency",
]
