"""Evaluation: accuracy, macro F1, confusion matrix, cross-entropy, step/epoch
metrics and top-k runs from a metric log.

All metrics are grouped aggregates: partial aggregation runs in every task and
only per-class (or per-batch) partial sums cross the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from lexiframe.functions.vectors import as_doubles, logsumexp


def per_class_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(cls, n_true, n_pred, tp)`` over truth and predictions (full outer by class)."""
    truth = df.groupBy(F.col(label).alias("cls")).agg(
        F.count(F.lit(1)).alias("n_true"),
        F.sum((F.col(label) == F.col(prediction)).cast("long")).alias("tp"))
    pred = df.groupBy(F.col(prediction).alias("cls")).agg(F.count(F.lit(1)).alias("n_pred"))
    return (truth.join(pred, "cls", "full_outer")
            .select("cls", F.coalesce("n_true", F.lit(0)).alias("n_true"),
                    F.coalesce("n_pred", F.lit(0)).alias("n_pred"),
                    F.coalesce("tp", F.lit(0)).alias("tp")))


def per_class_f1(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """F1 per class: 2tp / (2tp + fp + fn) = 2tp / (n_true + n_pred), 0 if undefined."""
    counts = per_class_counts(df, label, prediction)
    denom = F.col("n_true") + F.col("n_pred")
    return counts.withColumn("f1", F.when(denom > 0, 2.0 * F.col("tp") / denom).otherwise(F.lit(0.0)))


def evaluate(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy, macro F1, number of rows, number of classes."""
    f1 = per_class_f1(df, label, prediction)
    return f1.agg(
        (F.sum("tp") / F.sum("n_true")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.sum("n_true").alias("n"),
        F.count(F.lit(1)).alias("n_classes"))


def confusion_long(df: DataFrame, label: str = "label", prediction: str = "prediction",
                   labels: Sequence | None = None) -> DataFrame:
    """``(label, prediction, n)`` for every pair of classes, zero-filled.

    The class axis is ``labels`` when given, else truth and predictions
    together.  The axis is one array built by a global aggregate over the
    (at most C x C) count table and exploded twice: the output is the C x C
    matrix itself, independent of the number of rows, and the counts are
    computed once (no subquery re-runs the scoring plan).
    """
    counts = df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))
    if labels is not None:
        axis_row = counts.sparkSession.range(1).select(
            F.array(*[F.lit(v) for v in sorted(labels)]).alias("_lf_axis"))
    else:
        axis_row = counts.agg(F.sort_array(F.array_union(F.collect_set("label"),
                                                         F.collect_set("prediction"))).alias("_lf_axis"))
    grid = (axis_row.select(F.explode("_lf_axis").alias("label"), "_lf_axis")
            .select("label", F.explode("_lf_axis").alias("prediction")))
    return (grid.join(counts, ["label", "prediction"], "left")
            .select("label", "prediction", F.coalesce("n", F.lit(0)).alias("n")))


def cross_entropy(df: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    """Mean of ``logsumexp(logits) - logits[label]`` (label is a 0-based index)."""
    v = as_doubles(logits)
    per_row = logsumexp(v) - F.element_at(v, F.col(label).cast("int") + 1)
    return df.agg(F.avg(per_row).alias("cross_entropy"), F.count(F.lit(1)).alias("n"))


def step_and_epoch(df: DataFrame, run: str, batch: str, label: str = "label",
                   prediction: str = "prediction") -> DataFrame:
    """Per-batch (step) and per-run (epoch) accuracy in one grouping-sets pass.

    ``grain`` is ``step`` or ``epoch``; the epoch value weighs batches by size.
    """
    correct = (F.col(label) == F.col(prediction)).cast("double")
    out = df.groupingSets([[run, batch], [run]], run, batch).agg(
        F.avg(correct).alias("accuracy"), F.count(F.lit(1)).alias("n"),
        F.grouping(batch).alias("_lf_g"))
    return out.withColumn("grain", F.when(F.col("_lf_g") == 1, "epoch").otherwise("step")).drop("_lf_g")


def write_with_metrics(df: DataFrame, path: str, classes: Sequence, label: str = "label",
                       prediction: str = "prediction") -> tuple[DataFrame, DataFrame]:
    """Write predictions and count the confusion of ``classes`` in the same pass.

    The counts are observed while rows go by (one per pair of classes, summed by
    the tasks), so nothing is read again.  Returns the written rows and the
    ``(label, prediction, n)`` grid; ``metrics_of`` turns the grid into accuracy and
    macro F1.  Rows with a class outside ``classes`` are an error."""
    classes = sorted(classes)
    seen = Observation()
    pairs = [(a, b) for a in classes for b in classes]
    counts = [F.count_if((F.col(label) == F.lit(a)) & (F.col(prediction) == F.lit(b))).alias(f"n{i}") for i, (a, b) in enumerate(pairs)]
    df.observe(seen, F.count(F.lit(1)).alias("n"), *counts).write.mode("overwrite").parquet(path)
    got = seen.get
    if sum(got[f"n{i}"] for i in range(len(pairs))) != got["n"]:
        raise ValueError("rows with a class that was not named")
    spark = df.sparkSession
    kinds = f"label {df.schema[label].dataType.simpleString()}, prediction {df.schema[prediction].dataType.simpleString()}, n long"
    return spark.read.parquet(path), spark.createDataFrame([(a, b, got[f"n{i}"]) for i, (a, b) in enumerate(pairs)], kinds)


def metrics_of(grid: DataFrame) -> DataFrame:
    """Accuracy, macro F1, rows and classes (of truth or predictions) of a confusion grid."""
    tp = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    ends = grid.select("n", (F.col("label") == F.col("prediction")).alias("right"), F.explode(F.array(
        F.struct(F.col("label").alias("cls"), F.lit(True).alias("is_true")), F.struct(F.col("prediction").alias("cls"), F.lit(False).alias("is_true")))).alias("e"))
    per = ends.groupBy("e.cls").agg(F.sum("n").alias("both"), F.sum(F.when(F.col("right"), F.col("n")).otherwise(0)).alias("tp2")).filter("both > 0")
    macro = per.agg(F.avg(F.col("tp2") / F.col("both")).alias("macro_f1"), F.count(F.lit(1)).alias("n_classes"))
    return grid.agg((tp / F.sum("n")).alias("accuracy"), F.sum("n").alias("n")).join(macro, F.lit(True)).select("accuracy", "macro_f1", "n", "n_classes")


def top_k_runs(metrics: DataFrame, run: str, step: str, value: str, k: int = 2, mode: str = "max",
               metric: str | None = None) -> DataFrame:
    """Best ``k`` entries per run by ``value`` (``mode`` max/min), earliest step on ties,
    plus the last entry of each run; ``kind`` says which."""
    parts = [run] + ([metric] if metric else [])
    order = F.col(value).desc() if mode == "max" else F.col(value).asc()
    w = Window.partitionBy(*parts).orderBy(order, F.col(step))
    best = metrics.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    best = best.select(*parts, step, value, F.col("rank").cast("int").alias("rank"), F.lit("top").alias("kind"))
    # The last entry in one aggregate (max_by), partial per task: no join back.
    last = metrics.groupBy(*parts).agg(F.max(step).alias(step), F.max_by(value, step).alias(value))
    last = last.select(*parts, step, value, F.lit(0).alias("rank"), F.lit("last").alias("kind"))
    return best.unionByName(last)
