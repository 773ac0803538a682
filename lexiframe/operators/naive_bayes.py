"""Multinomial naive Bayes, fit and predict as relational plans.

Fit (smoothing ``alpha``):
    log_prior[c]   = ln(n_c / n)                      (documents per class)
    loglik[c, t]   = ln(N_ct + alpha) - ln(N_c + alpha * V)
where N_ct is the summed feature value of token t in class c, N_c = sum_t N_ct
and V the vocabulary size.

Predict, for a document with feature values x_t over known tokens:
    score[c] = log_prior[c] + L * (ln alpha - ln(N_c + alpha V))
               + sum_{t : N_ct > 0} x_t * (ln(N_ct + alpha) - ln alpha)
with L = sum_t x_t.  The term table has one row per token seen in training,
with one value per class, so a document's tokens are joined once and summed per
document in one exchange.  The class parameters (one row per class) travel as
one array value through a scalar subquery, so every document scores all classes
without a cross join.  The argmax takes the highest score and, on ties, the
first class in sorted order.

Fitting runs jobs: the term table is written to the shared folder; the class table
is one row per class.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.session import cut_lineage


@dataclass
class NaiveBayesModel:
    classes: DataFrame   # label, class_index, n_docs, log_prior, base_rate
    terms: DataFrame     # token, excess: one value per class in class order (0 where N_ct = 0)
    alpha: float

    @property
    def vocab(self) -> DataFrame:
        return self.terms.select("token")

    def save(self, path: str) -> None:
        self.classes.write.mode("overwrite").parquet(f"{path}/classes")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        spark = self.classes.sparkSession
        spark.createDataFrame([(self.alpha,)], "alpha double").write.mode("overwrite").parquet(f"{path}/params")

    @classmethod
    def load(cls, spark, path: str) -> "NaiveBayesModel":
        alpha = spark.read.parquet(f"{path}/params").first()["alpha"]
        return cls(spark.read.parquet(f"{path}/classes"), spark.read.parquet(f"{path}/terms"), alpha)


def fit_naive_bayes(features: DataFrame, doc_labels: DataFrame, key: str, label: str = "label",
                    value: str = "tf", alpha: float = 1.0) -> NaiveBayesModel:
    """Fit from rows ``(label, token, value)`` and ``(key, label)`` rows.

    ``features`` may hold several rows of a label and token: single
    occurrences, or (document, token) counts or weights; they are summed per class in
    every task before the one exchange by token.  Every labelled document
    counts toward the prior, even one without tokens.
    """
    labelled = features if label in features.columns else features.join(doc_labels.select(key, label), key, "inner")
    spark, log_alpha = features.sparkSession, math.log(alpha)
    # one row per class, in the order of the classes
    per_class = doc_labels.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_docs")).orderBy("label").collect()
    order = [r["label"] for r in per_class]
    sums = [F.coalesce(F.sum(F.when(F.col(label) == F.lit(c), F.col(value))), F.lit(0)).cast("double") for c in order]
    # one pass over the training texts, one exchange by token
    counted = cut_lineage(labelled.groupBy("token").agg(F.array(*sums).alias("n_ct") if order else F.array().cast("array<double>").alias("n_ct")), "nb-terms")
    v_size = counted.count()  # read from the files' footers
    mass = counted.agg(*[F.coalesce(F.sum(F.col("n_ct")[i]), F.lit(0.0)) for i in range(len(order))]).first() if order else []
    n_docs = sum(r["n_docs"] for r in per_class)
    rows = [(r["label"], i, r["n_docs"], math.log(r["n_docs"] / n_docs), log_alpha - math.log(mass[i] + alpha * v_size) if mass[i] + alpha * v_size > 0 else None)
            for i, r in enumerate(per_class)]
    kind = doc_labels.schema[label].dataType.simpleString()
    classes = spark.createDataFrame(rows, f"label {kind}, class_index int, n_docs long, log_prior double, base_rate double")
    terms = counted.select("token", F.transform("n_ct", lambda x: F.log(x + alpha) - F.lit(log_alpha)).alias("excess"))
    return NaiveBayesModel(classes, terms, alpha)


def predict_naive_bayes(model: NaiveBayesModel, features: DataFrame, docs: DataFrame, key: str,
                        value: str = "tf", out: str = "prediction", with_scores: bool = False) -> DataFrame:
    """Add ``out`` to every row of ``docs`` (documents with no known token get the prior).

    Every row of ``features`` adds ``value * excess`` to each class of its
    document and ``value`` to its known-token mass; unknown tokens fall out.
    """
    n_classes = model.classes.count()
    joined = features.select(key, "token", F.col(value).alias("_lf_v")).join(model.terms, "token", "inner")
    per_doc = joined.groupBy(key).agg(
        F.sum("_lf_v").cast("double").alias("_lf_len"),
        *[F.sum(F.col("_lf_v") * F.col("excess")[i]).alias(f"_lf_{i}") for i in range(n_classes)])
    class_arr = model.classes.select(
        F.sort_array(F.collect_list(F.struct("class_index", "label", "log_prior", "base_rate")))).scalar()
    sums = F.array(*[F.coalesce(F.col(f"_lf_{i}"), F.lit(0.0)) for i in range(n_classes)]) if n_classes else F.array().cast("array<double>")
    # The subquery value is attached as a column first: higher-order functions
    # may not contain subqueries.
    scored = (docs.join(per_doc, key, "left").withColumn("_lf_sums", sums)
              .withColumn("_lf_len", F.coalesce(F.col("_lf_len"), F.lit(0.0)))
              .withColumn("_lf_classes", class_arr))
    scores = F.zip_with("_lf_classes", "_lf_sums", lambda c, x: F.struct(
        (c["log_prior"] + F.col("_lf_len") * c["base_rate"] + x).alias("score"),
        (-c["class_index"]).alias("neg_index"),
        c["label"].alias("label")))
    best = F.array_max(scores)
    return scored.select(*docs.columns, best["label"].alias(out), *([scores.alias("scores")] if with_scores else []))
