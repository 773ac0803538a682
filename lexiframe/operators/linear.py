"""Linear heads with MLlib.

Linear probe: multinomial logistic regression without regularisation on
frozen vectors (softmax + cross-entropy, the trained head of a frozen encoder).
Fitting runs jobs.  Support-vector machines are in ``operators.svm`` and
``operators.kernel_maps``.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_linear_probe(train: DataFrame, vec: str, label: str, max_iter: int = 100) -> PipelineModel:
    data = train.select(array_to_vector(F.col(vec)).alias("features"),
                        F.col(label).cast("double").alias("label")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        lr = LogisticRegression(family="multinomial", regParam=0.0, maxIter=max_iter)
        return PipelineModel(stages=[lr.fit(data)])
    finally:
        data.unpersist()


def apply_linear_probe(model: PipelineModel, df: DataFrame, vec: str, keep=()) -> DataFrame:
    data = df.select(*keep, array_to_vector(F.col(vec)).alias("features"))
    return model.transform(data).select(*keep, F.col("prediction").cast("int").alias("prediction"))


def probe_optimality(model: PipelineModel, df: DataFrame, vec: str, label: str) -> DataFrame:
    """One row: rows, classes, mean cross-entropy, and the largest absolute mean
    gradient over weights and biases (near 0 at an optimum)."""
    probs = model.transform(df.select(F.col(label).cast("int").alias("y"), array_to_vector(F.col(vec)).alias("features")))
    rows = probs.select("y", vector_to_array("probability").alias("p"), vector_to_array("features").alias("x"))
    loss = rows.agg(F.count("*").alias("n"), F.max(F.size("p")).alias("n_classes"),
                    F.avg(-F.log(F.greatest(F.element_at("p", F.col("y") + 1), F.lit(1e-300)))).alias("loss"))
    off = rows.select(F.concat("x", F.array(F.lit(1.0))).alias("x"), F.posexplode(F.zip_with(
        "p", F.sequence(F.lit(0), F.size("p") - 1), lambda q, j: q - (j == F.col("y")).cast("double"))).alias("j", "e"))
    cells = off.select("j", "e", F.posexplode("x").alias("k", "v")).groupBy("j", "k").agg(F.avg(F.col("e") * F.col("v")).alias("g"))
    return loss.withColumn("gradient", cells.agg(F.max(F.abs("g"))).scalar())


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


__all__ = ["probe_optimality", "fit_linear_probe", "apply_linear_probe", "save_model", "load_model"]
