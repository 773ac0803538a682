"""Linear support-vector machines whose weights are a table.

Training rows are ``(row, label, term, value)``, or for images of a kernel map, whose
terms are the places 0, 1, ..., ``(row, label, width, values, bias)``, a row of numbers each.  The solver is dual coordinate
ascent on the rows that decide the fit (``svm_working_set``): blocks of rows are solved
by themselves once, the rows that got a dual variable are solved together, and every
round takes the slack of all rows and goes on with those inside the margin.  Nothing
but a few numbers per task (a class against the rest, or a pair of classes) reaches
the driver: the primal and the dual objective, whose gap bounds how far the fit is
from the optimum.  The fit stops when every task's gap is at most ``tolerance`` of its
primal objective; a fit that does not get there in ``rounds`` is an error, never a
result.  More rows than one block holds, of few different terms, are fitted by Newton
steps (``svm_newton``), with the same gap.

The objective of a task is ``|w|^2 / 2 + C sum(max(0, 1 - y w.x))``; the constant
term ``BIAS`` (value 1 in every row) is regularised like any other.

Defined results: rows without terms have the bias alone; rows without a label take
no part; equal (row, term) pairs must be one row; ties of scores or votes go to the
first class in sorted order; with a single class there are no tasks and it is
always predicted.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from lexiframe.functions.worker import frugal
from lexiframe.operators import svm_newton, svm_working_set
from lexiframe.session import cut_lineage

#: The constant term (word tokens are never empty).
BIAS = ""
#: Values that one group of rows is solved with, and rounds before the fit fails.
BLOCK_VALUES, ROUNDS = 1 << 22, 400


@dataclass
class LinearModel:
    """``classes`` in order; ``tasks`` as (class, other class or None for the rest);
    ``weights``: ``(term, w)`` with one value per task; ``duals``: ``(row, alpha)``
    of the training rows with a nonzero one; ``gaps``: relative, per task."""

    classes: list
    tasks: list[tuple[int, int | None]]
    weights: DataFrame
    duals: DataFrame
    gaps: list[float]
    c: float

    def save(self, path: str) -> None:
        spark = self.weights.sparkSession
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        self.duals.write.mode("overwrite").parquet(f"{path}/duals")
        spark.createDataFrame(list(enumerate(self.classes))).toDF("i", "label").coalesce(1).write.mode("overwrite").parquet(f"{path}/classes")
        tasks = [(i, a, b, g, self.c) for i, ((a, b), g) in enumerate(zip(self.tasks, self.gaps, strict=True))]
        spark.createDataFrame(tasks, "i int, a int, b int, gap double, c double").coalesce(1).write.mode("overwrite").parquet(f"{path}/tasks")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearModel:
        classes = [r["label"] for r in spark.read.parquet(f"{path}/classes").orderBy("i").collect()]
        tasks = spark.read.parquet(f"{path}/tasks").orderBy("i").collect()
        return cls(classes, [(r["a"], r["b"]) for r in tasks], spark.read.parquet(f"{path}/weights"), spark.read.parquet(f"{path}/duals"),
                   [r["gap"] for r in tasks], tasks[0]["c"] if tasks else 1.0)


def task_signs(tasks: list[tuple[int, int | None]], n_classes: int) -> np.ndarray:
    """Per class and task: 1 for the class, -1 for the other side, 0 for rows that take no part."""
    out = np.zeros((n_classes, len(tasks)))
    for t, (a, b) in enumerate(tasks):
        if b is None:
            out[:, t] = -1
        else:
            out[b, t] = -1
        out[a, t] = 1
    return out


def training_rows(features: DataFrame, docs: DataFrame, key: str, label: str, value: str, term: str = "token") -> tuple[DataFrame, list]:
    """``(row, class, term, value)``, the bias included, written once; and the classes in order."""
    classes = [r[0] for r in docs.filter(F.col(label).isNotNull()).select(label).distinct().orderBy(label).collect()]  # one value per class
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("int") - 1 if classes else F.lit(0)
    known = docs.filter(F.col(label).isNotNull()).select(F.col(key).cast("string").alias("row"), place.alias("class"))
    if _is_dense(features, value):
        return cut_lineage(_dense_rows(features.select(F.col(key).cast("string").alias("row"), F.col(value).alias("values")), known), "svm-rows"), classes
    own = features.select(F.col(key).cast("string").alias("row"), F.col(term).alias("term"), F.col(value).cast("double").alias("value"))
    rows = own.join(known, "row").select("row", "class", "term", "value").unionByName(known.select("row", "class", F.lit(BIAS).alias("term"), F.lit(1.0).alias("value")))
    return cut_lineage(rows, "svm-rows"), classes


def _is_dense(table: DataFrame, value: str) -> bool:
    return value in table.columns and isinstance(table.schema[value].dataType, ArrayType)


def _dense_rows(own: DataFrame, known: DataFrame) -> DataFrame:
    """``(row, class, width, values, bias)``: one row per row and class; those that share a row are added."""
    both = own.filter(F.col("row").isNotNull()).withColumn("class", F.lit(None).cast("int")).unionByName(known.withColumn("values", F.lit(None).cast("array<double>")))
    per = both.groupBy("row").agg(F.collect_list("values").alias("x"), F.collect_list("class").alias("c"))
    rest = F.slice("x", F.lit(2), F.greatest(F.size("x") - 1, F.lit(0)))
    added = F.when(F.size("x") <= 1, F.get("x", F.lit(0))).otherwise(F.aggregate(rest, F.get("x", F.lit(0)), lambda s, x: F.zip_with(s, x, lambda a, b: a + b)))
    each = per.select("row", "c", F.coalesce(added, F.array().cast("array<double>")).alias("x"), F.explode(F.array_distinct("c")).alias("class"))
    times = each.withColumn("n", F.size(F.filter("c", lambda k: k == F.col("class"))).cast("double"))
    return times.select("row", "class", F.size("x").alias("width"), F.when(F.col("n") == 1, F.col("x")).otherwise(F.transform("x", lambda v: v * F.col("n"))).alias("values"),
                        F.col("n").alias("bias"))


def long_rows(rows: DataFrame) -> DataFrame:
    """Dense training rows as ``(row, class, term, value)``."""
    values = rows.select("row", "class", F.posexplode("values").alias("term", "value")).withColumn("term", F.col("term").cast("string"))
    return values.unionByName(rows.select("row", "class", F.lit(BIAS).alias("term"), F.col("bias").alias("value")))


def fit_svm(rows: DataFrame, classes: list, against: str = "rest", c: float = 1.0, tolerance: float = 0.01, rounds: int = ROUNDS,
            block_values: int = BLOCK_VALUES) -> LinearModel:
    """Fit on ``training_rows``: every class against the ``rest``, or all ``pairs`` of classes."""
    spark = rows.sparkSession
    n_classes = len(classes)
    tasks = [(i, None) for i in range(n_classes)] if against == "rest" else list(combinations(range(n_classes), 2))
    if n_classes < 2:
        tasks = []
    n = len(tasks)
    if not n:
        return LinearModel(classes, [], spark.createDataFrame([], "term string, w array<double>"), spark.createDataFrame([], "row string, alpha array<double>"), [], c)
    terms, size = None, rows.count()  # a written table: read from the files' footers
    if _is_dense(rows, "values"):
        width = rows.agg(F.coalesce(F.max("width"), F.lit(0))).first()[0]
        size *= width + 1
        if size > block_values and svm_newton.fits(width + 1, n):
            terms = [*map(str, range(width)), BIAS]
        else:
            rows = cut_lineage(long_rows(rows), "svm-long")
    elif size > block_values:
        terms = svm_newton.few_terms(rows, n)
    if terms is not None:
        w, alphas, gaps = svm_newton.fit(rows, terms, task_signs(tasks, n_classes), c, tolerance, rounds)
        table = spark.createDataFrame([(term, w[i].tolist()) for i, term in enumerate(terms)], "term string, w array<double>")
        return LinearModel(classes, tasks, table, alphas, gaps, c)
    table, alphas, gaps = svm_working_set.fit(rows, task_signs(tasks, n_classes), c, tolerance, rounds, block_values)
    return LinearModel(classes, tasks, table, alphas, gaps, c)


def margins(features: DataFrame, docs: DataFrame, model: LinearModel, key: str, value: str, term: str = "token") -> DataFrame:
    """``docs`` with ``_lf_m``: the margin of every task.  One join by term and one sum per row;
    ``features`` with arrays hold products with the weights already, without the bias."""
    n = len(model.tasks)
    if _is_dense(features, value):
        per = features.groupBy(key).agg(*[F.sum(F.col(value)[i]).alias(f"_lf_{i}") for i in range(n)])
    else:
        known = features.select(key, F.col(term).alias("term"), F.col(value).cast("double").alias("_lf_v")).join(model.weights, "term")
        per = known.groupBy(key).agg(*[F.sum(F.col("_lf_v") * F.col("w")[i]).alias(f"_lf_{i}") for i in range(n)])
    bias = model.weights.filter(F.col("term") == BIAS).select("w").scalar()
    out = docs.join(per, key, "left").withColumn("_lf_b", bias)
    m = F.array(*[F.coalesce(f"_lf_{i}", F.lit(0.0)) + F.coalesce(F.col("_lf_b")[i], F.lit(0.0)) for i in range(n)]) if n else F.array().cast("array<double>")
    return out.withColumn("_lf_m", m).select(*docs.columns, "_lf_m")


def image_weights(model: LinearModel, width: int | None = None) -> np.ndarray:
    """Weights of a model of images, terms by tasks, the bias last; bounded by the map's width."""
    held = {r["term"]: r["w"] for r in model.weights.collect()}
    width = max([int(t) + 1 for t in held if t != BIAS], default=0) if width is None else width
    return np.array([held.get(t, [0.0] * len(model.tasks)) for t in [*map(str, range(width)), BIAS]])


def _image_sums(rows: DataFrame, model: LinearModel, signs: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Of dense training rows: the weights that the dual variables imply, ``(term, d..)``, and the hinges, ``(h..)``."""
    n = len(model.tasks)
    width = rows.agg(F.coalesce(F.max("width"), F.lit(0))).first()[0]
    w = image_weights(model, width)

    def hinge(batches):
        total = np.zeros(n)
        for batch in batches:
            y = signs[batch.column("class").to_numpy()]
            total += (np.maximum(0, 1 - y * (svm_newton.dense(batch, width + 1) @ w)) * (y != 0)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names=[f"p{t}" for t in range(n)])

    def imply(batches):
        total = np.zeros((width + 1, n))
        for batch in batches:
            if batch.num_rows:
                alpha = batch.column("alpha").flatten().to_numpy().reshape(-1, n)
                total += svm_newton.dense(batch, width + 1).T @ (alpha * signs[batch.column("class").to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1)), *[pa.array(total[:, t]) for t in range(n)]], names=["term", *[f"p{t}" for t in range(n)]])

    parts = ", ".join(f"p{t} double" for t in range(n))
    hinges = rows.select("class", "values", "bias").mapInArrow(frugal(hinge), parts).agg(*[F.coalesce(F.sum(f"p{t}"), F.lit(0.0)).alias(f"h{t}") for t in range(n)])
    joined = rows.select("row", "class", "values", "bias").join(model.duals, "row").drop("row")
    implied = joined.mapInArrow(frugal(imply), f"term long, {parts}").groupBy("term").agg(*[F.sum(f"p{t}").alias(f"d{t}") for t in range(n)])
    return implied, hinges


def predict_svm(model: LinearModel, features: DataFrame, docs: DataFrame, key: str, value: str, term: str = "token", out: str = "prediction") -> DataFrame:
    """Add the predicted class: the largest margin, or the most votes of the pairs."""
    if not model.tasks:
        return docs.withColumn(out, F.lit(model.classes[0]) if model.classes else F.lit(None))
    scored = margins(features, docs, model, key, value, term)
    if model.tasks[0][1] is None:
        points = [F.col("_lf_m")[i] for i in range(len(model.classes))]
    else:
        votes = {k: [] for k in range(len(model.classes))}
        for t, (a, b) in enumerate(model.tasks):
            first = F.col("_lf_m")[t] >= 0
            votes[a].append(first.cast("int"))
            votes[b].append((~first).cast("int"))
        points = [sum(votes[k], F.lit(0)).cast("double") for k in range(len(model.classes))]
    best = F.array_max(F.array(*[F.struct(p.alias("p"), F.lit(-k).alias("k")) for k, p in enumerate(points)]))
    return scored.select(*docs.columns, F.element_at(F.array(*[F.lit(c) for c in model.classes]), 1 - best["k"]).alias(out))


def certificate(rows: DataFrame, model: LinearModel) -> DataFrame:
    """One row: the largest relative gap over the tasks, computed from the written
    weights and dual variables alone (primal from the weights, dual from the weights
    that the dual variables imply).  Weak duality makes it a proof, whoever fitted."""
    n, c = len(model.tasks), model.c
    signs = task_signs(model.tasks, len(model.classes))
    sign = [F.element_at(F.array(*[F.lit(float(s)) for s in signs[:, t]]), F.col("class") + 1) for t in range(n)]
    if _is_dense(rows, "values"):
        implied, hinges = _image_sums(rows, model, signs)
    else:
        duals = rows.join(model.duals, "row")
        implied = duals.groupBy("term").agg(*[F.sum(F.col("alpha")[t] * sign[t] * F.col("value")).alias(f"d{t}") for t in range(n)])
        scored = rows.join(model.weights, "term", "left").groupBy("row", "class").agg(
            *[F.sum(F.col("value") * F.coalesce(F.col("w")[t], F.lit(0.0))).alias(f"m{t}") for t in range(n)])
        hinges = scored.agg(*[F.sum(F.when(sign[t] != 0, F.greatest(F.lit(0.0), 1 - sign[t] * F.col(f"m{t}"))).otherwise(0.0)).alias(f"h{t}") for t in range(n)])
    alphas = model.duals.agg(*[F.coalesce(F.sum(F.col("alpha")[t]), F.lit(0.0)).alias(f"a{t}") for t in range(n)],
                             F.coalesce(F.max(F.array_max("alpha")) <= c * (1 + 1e-9), F.lit(True)).alias("feasible"))
    squares = model.weights.agg(*[F.coalesce(F.sum(F.col("w")[t] * F.col("w")[t]), F.lit(0.0)).alias(f"p{t}") for t in range(n)])
    other = implied.agg(*[F.coalesce(F.sum(F.col(f"d{t}") * F.col(f"d{t}")), F.lit(0.0)).alias(f"q{t}") for t in range(n)])
    # four tables of one row each
    one = alphas.join(hinges, F.lit(True)).join(squares, F.lit(True)).join(other, F.lit(True))
    primal = [F.col(f"p{t}") / 2 + c * F.col(f"h{t}") for t in range(n)]
    gap = [(p - (F.col(f"a{t}") - F.col(f"q{t}") / 2)) / p for t, p in enumerate(primal)]
    return one.select(F.greatest(*gap, F.lit(0.0)).alias("gap"), "feasible")
