"""Support-vector machines on few terms: Newton steps on a smoothed hinge.

For tables whose rows have few different terms (images of a kernel map) the second
derivative of a task is a matrix of terms by terms.  The hinge is replaced by a parabola
on its first ``h``; every pass over the rows sums each task's gradient and matrix inside
its tasks, partial sums meet by task, and the driver solves one system per task.  Where the whole
step does not lower the smoothed objective, another pass evaluates it at fixed steps.  No state
is kept per row: the dual variables are the smoothed hinge's slopes at the weights, so

    primal - dual = |w - X'(alpha y)|^2 / 2 + sum(c max(0, u) - alpha u),   u = 1 - y w.x

for the unsmoothed objective.  The first part falls with the steps and the second with
``h``; a task ends when both together are at most ``tolerance`` of its primal objective.
The number of passes does not depend on how rows are dealt.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.functions.worker import frugal
from lexiframe.session import cut_lineage

#: Numbers of all tasks' matrices at most (they reach the driver); values of a partition.
MATRIX_VALUES, PART_VALUES = 1 << 22, 1 << 19
#: The first ``h``, at which all rows are on the parabola; ``h`` falls once the gap's first part is at most so
#: many times the second.  Values of the rows that are summed at once.
WIDEST, NEAR, PIECE_VALUES = 2.0, 10.0, 1 << 18
STEPS = 2.0 ** -np.arange(12)


def fits(n_terms: int, n_tasks: int) -> bool:
    return n_terms <= int((MATRIX_VALUES / n_tasks) ** 0.5)


def few_terms(rows: DataFrame, n_tasks: int) -> list | None:
    """The terms in order; None if their matrices would be too large."""
    most = int((MATRIX_VALUES / n_tasks) ** 0.5)
    terms = [r[0] for r in rows.select("term").distinct().limit(most + 1).collect()]
    return sorted(terms) if len(terms) <= most else None


def by_row(rows: DataFrame, terms: list) -> DataFrame:
    """``(row, class, codes, values)``, written once."""
    spark = rows.sparkSession
    coded = rows.join(F.broadcast(spark.createDataFrame(list(zip(terms, range(len(terms)), strict=True)), "term string, code int")), "term")
    parts = max(1, min(-(-rows.count() // PART_VALUES), 2 * spark.sparkContext.defaultParallelism))
    item = F.collect_list(F.struct("code", "value")).alias("t")
    per = coded.repartition(parts, "row", "class").groupBy("row", "class").agg(item)
    return cut_lineage(per.select("row", "class", F.transform("t", lambda x: x["code"]).alias("codes"), F.transform("t", lambda x: x["value"]).alias("values")), "svm-by-row")


def dense(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Rows by terms: of ``codes`` and ``values``, or of images, with the bias last."""
    x = np.zeros((batch.num_rows, width))
    values = batch.column("values")
    n = values.value_lengths().to_numpy(zero_copy_only=False)
    flat = values.flatten().to_numpy()
    if "bias" in batch.schema.names:
        if (n == width - 1).all():
            x[:, :-1] = flat.reshape(batch.num_rows, width - 1)
        else:
            x[np.repeat(np.arange(batch.num_rows), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
        x[:, -1] = batch.column("bias").to_numpy()
    else:
        x[np.repeat(np.arange(batch.num_rows), n), batch.column("codes").flatten().to_numpy()] = flat
    return x


def _added(table: DataFrame, run, active: list[int], width: int) -> dict[int, np.ndarray]:
    """One array per active task, summed over the partitions."""
    step = max(1, PIECE_VALUES // width)

    def add(group: pa.Table) -> pa.Table:
        v = group.column("v").combine_chunks()
        total = v.flatten().to_numpy().reshape(len(v), -1).sum(axis=0)
        return pa.table({"task": group.column("task").slice(0, 1), "v": pa.array([total], pa.list_(pa.float64()))})

    def partial(batches):
        sums: dict = {}
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                for t, v in run(batch.slice(i, step)):
                    sums[t] = np.add(sums[t], v, out=sums[t]) if t in sums else v
        for t, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([v], pa.list_(pa.float64()))], names=["task", "v"])

    kind = "task int, v array<double>"
    # one array per task, at most MATRIX_VALUES numbers and a few more
    got = {r["task"]: np.array(r["v"]) for r in table.mapInArrow(frugal(partial), kind).groupBy("task").applyInArrow(add, kind).collect()}
    return {t: got[t] for t in active}


def _slopes(u, c, h):
    return np.clip(c * u / h, 0.0, c)


def _at(signs, w, h, c, active):
    """Hinge, smoothing part of the gap, sum of slopes, smoothed hinge, X'(alpha y) and the matrix."""
    width, w = len(w), w.copy()

    def run(batch):
        x, cls = dense(batch, width), batch.column("class").to_numpy()
        m = x @ w
        for t in active:
            y = signs[cls, t]
            u = 1 - y * m[:, t]
            alpha = _slopes(u, c, h[t]) * (y != 0)
            over = c * np.maximum(0, u) * (y != 0)
            zone = x[(alpha > 0) & (alpha < c)]
            smoothed = alpha * u - alpha * alpha * h[t] / (2 * c)
            yield t, np.concatenate([[over.sum(), (over - alpha * u).sum(), alpha.sum(), smoothed.sum()], (alpha * y) @ x, (zone.T @ zone).ravel() * (c / h[t])])

    return run


def _along(signs, w, direction, h, c, active):
    """The smoothed hinge at every step."""
    width = len(w)

    def run(batch):
        x, cls = dense(batch, width), batch.column("class").to_numpy()
        for t in active:
            y = signs[cls, t]
            u = (1 - y * (x @ w[:, t]))[:, None] - (y * (x @ direction[:, t]))[:, None] * STEPS
            a = _slopes(u, c, h[t])
            yield t, ((a * u - a * a * h[t] / (2 * c)) * (y != 0)[:, None]).sum(axis=0)

    return run


def _descend(table, signs, w, h, c, tolerance, rounds) -> list[float]:
    """Moves ``w`` and lowers ``h`` in place until every task's gap is at most the tolerance; the gaps.
    A step is tried whole, and shortened after another pass only where the objective did not fall enough."""
    width, n = w.shape
    gaps, active, tried = [np.inf] * n, list(range(n)), {}
    for _ in range(2 * rounds):
        here, too_far = _added(table, _at(signs, w, h, c, active), active, width), {}
        for t in active:
            over, smooth, alphas, hinge = here[t][:4]
            g, matrix = here[t][4:4 + width], here[t][4 + width:].reshape(width, width)
            primal, rest, value = w[:, t] @ w[:, t] / 2 + over, w[:, t] - g, w[:, t] @ w[:, t] / 2 + hinge
            gaps[t] = float((primal - (alphas - g @ g / 2)) / primal) if primal else 0.0
            start, direction, before, slope = tried.pop(t, (None, None, np.inf, 0.0))
            if gaps[t] <= tolerance:
                continue
            if value > before + 1e-4 * slope:
                too_far[t] = start, direction
            elif rest @ rest / 2 <= NEAR * smooth and smooth > 0.4 * tolerance * primal:
                h[t] *= np.clip(0.4 * tolerance * primal / smooth, 0.5, 0.7)
            else:
                direction = -np.linalg.solve(matrix + np.eye(width), rest)
                tried[t] = w[:, t].copy(), direction, value, rest @ direction
                w[:, t] += direction
        active = [t for t in active if gaps[t] > tolerance]
        if not active:
            break
        if too_far:
            base, along = np.zeros_like(w), np.zeros_like(w)
            for t, (start, direction) in too_far.items():
                base[:, t], along[:, t] = start, direction
            found = _added(table, _along(signs, base, along, h, c, list(too_far)), list(too_far), width)
            for t, (start, d) in too_far.items():
                total = (start @ start + 2 * STEPS * (start @ d) + STEPS * STEPS * (d @ d)) / 2 + found[t]
                w[:, t] = start + STEPS[int(np.argmin(total))] * d
    return gaps


def fit(rows: DataFrame, terms: list, signs: np.ndarray, c: float, tolerance: float, rounds: int) -> tuple[np.ndarray, DataFrame, list[float]]:
    """Weights (terms by tasks), the dual variables ``(row, alpha)`` and the relative gaps."""
    width, n = len(terms), signs.shape[1]
    # every partition has a matrix per task to move
    table = (rows if "bias" in rows.columns else by_row(rows, terms)).coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)
    w, h = np.zeros((width, n)), np.full(n, WIDEST)
    gaps = _descend(table, signs, w, h, c, tolerance, rounds)
    if max(gaps) > tolerance:
        raise RuntimeError(f"no convergence in {rounds} rounds: relative gaps {gaps}")
    return w, cut_lineage(_duals(table, signs, w, h, c), "svm-duals"), gaps


def _duals(table, signs, w, h, c):
    def run(batches):
        for batch in batches:
            y = signs[batch.column("class").to_numpy()]
            alpha = _slopes(1 - y * (dense(batch, len(w)) @ w), c, h) * (y != 0)
            held = np.flatnonzero(alpha.any(axis=1))
            lists = pa.ListArray.from_arrays(pa.array((np.arange(len(held) + 1) * alpha.shape[1]).astype(np.int32)), pa.array(alpha[held].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(held)), lists], names=["row", "alpha"])

    return table.mapInArrow(frugal(run), "row string, alpha array<double>")
