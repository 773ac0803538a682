"""Batch model scoring: vectors through ``predict_batch_udf``, token ids through Arrow batches.

The caller supplies ``make_model()`` which returns ``predict(np.ndarray) ->
np.ndarray``; it is called once per Python worker (not per row or batch), and
rows travel as Arrow batches of ``batch_size``.  No model weights ship with
this package: the seam takes whatever model the caller loads.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiframe.functions.vectors import argmax, dot, softmax
from lexiframe.session import cut_lineage


def score_vectors(df: DataFrame, vec: str, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]],
                  n_outputs: int, dim: int, batch_size: int = 256, out: str = "logits") -> DataFrame:
    """Apply a vector model to an ARRAY<FLOAT|DOUBLE> column of width ``dim``;
    ``out`` is ARRAY<DOUBLE> of width ``n_outputs``."""
    udf = predict_batch_udf(make_model, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
                            input_tensor_shapes=[[dim]])
    return df.withColumn(out, udf(F.col(vec).cast("array<double>")))


def class_means(df: DataFrame, vec: str, label: str) -> DataFrame:
    """``(label, mean)``: the mean vector of every label, summed element by
    element in every task before the exchange.  Fitting runs a job."""
    parts = df.select(F.col(label).alias("label"), F.posexplode(F.col(vec).cast("array<double>")).alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg("x").alias("x"))
    rows = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    return cut_lineage(rows.select("label", F.transform("v", lambda e: e["x"]).alias("mean")), "class-means")


def mean_logits(df: DataFrame, vec: str, means: DataFrame, out: str = "logits") -> DataFrame:
    """``out``: dot products of the whole vector with each label's mean, in label order."""
    table = means.select(F.sort_array(F.collect_list(F.struct("label", "mean")))).scalar()  # classes x width values
    rows = df.withColumn("_lf_means", table)
    return rows.withColumn(out, F.transform("_lf_means", lambda m: dot(F.col(vec), m["mean"]))).drop("_lf_means")


def means_model(means: DataFrame):
    """The same read-out as a model for ``score_vectors``: one matrix of
    classes x width, collected once."""
    matrix = np.array([r["mean"] for r in means.orderBy("label").collect()])

    def make():
        def predict(x: np.ndarray) -> np.ndarray:
            return np.asarray(x, dtype=np.float64) @ matrix.T

        return predict

    return make


def project(vec, weights: Sequence[Sequence[float]]):
    """Linear projection: one dot product per row of ``weights``."""
    return F.array(*[dot(vec, F.array(*[F.lit(float(w)) for w in row])) for row in weights])


def score_text(df: DataFrame, ids: str, mask: str, make_model: Callable[[], Callable], n_outputs: int,
               label_names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Score token ids with a caller's model: adds ``probs`` and ``prediction``
    (the label's name).

    ``make_model()`` returns ``predict(input_ids, attention_mask) -> logits``
    (integer arrays, one row per text) and is called once per Python worker;
    rows of an Arrow batch are padded to their longest.
    """
    def run(batches):
        model = make_model()
        for b in batches:
            n = b.num_rows
            ids_of, mask_of = (b.column(c).to_pylist() for c in (ids, mask))
            width = max((len(x) for x in ids_of), default=0)
            x, m = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
            for i, (u, v) in enumerate(zip(ids_of, mask_of, strict=True)):
                x[i, : len(u)], m[i, : len(v)] = u, v
            logits = np.asarray(model(x, m), dtype=np.float64).reshape(n, n_outputs)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(list(logits), pa.list_(pa.float64()))],
                                             names=[*keep, "logits"])

    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("logits", T.ArrayType(T.DoubleType()))])
    scored = df.select(*keep, *[c for c in (ids, mask) if c not in keep]).mapInArrow(run, schema)
    names = F.array(*[F.lit(x) for x in label_names])
    return scored.withColumn("probs", softmax("logits")).withColumn("prediction", F.element_at(names, argmax("logits") + 1))
