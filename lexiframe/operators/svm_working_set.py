"""Support-vector machines on many terms: rounds on a working set of rows.

Few rows decide a fit: those inside the margin.  The rows are dealt into blocks once and
coded by each block's own terms.  A first short solution of every block by itself names
its rows with a nonzero dual variable; these are the first working set.  Each round then

* solves each task on its working set by dual coordinate ascent, in one group per task
  (in parts of at most ``block_values`` values if it is larger: the changes of the parts
  are summed by term, and all move along that sum as far as the dual objective grows),
* joins the weights with every block's terms and takes the slack of every row.

The gap counts the slacks of all rows, in the working set or not, so no row is left out
of the objective; all rows with a slack and all with a nonzero dual variable are the next
working set.  The driver sees sums per task only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.session import cut_lineage

#: Passes over a block in its first solution and over a part of a working set; over a whole one in the first
#: round (twice and four times as many later), until its own gap is SHARE of the tolerance.
OPENING, PASSES, WHOLE_PASSES, SHARE = 3, 16, 64, 0.3

_PACKED = "block long, row string, class int, codes array<int>, values array<double>, opened array<int>, term string, code int"
_MOVED = "task int, term string, step double, row string, old double, new double"


def _ranks(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Distinct strings in order, and the place of each."""
    coded = column.cast(pa.string()).combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), rank[coded.indices.to_numpy(zero_copy_only=False)]


def _by_row(table: pa.Table):
    """Names of rows and terms; where each row starts among ``code`` and ``value``; the
    place in the table where each row's first value came from."""
    (names, index), (terms, code) = _ranks(table.column("row")), _ranks(table.column("term"))
    order = np.lexsort((code, index))
    index, code, value = index[order], code[order], table.column("value").to_numpy()[order]
    new = np.flatnonzero(np.r_[True, (index[1:] != index[:-1]) | (code[1:] != code[:-1])])
    index, code, value = index[new], code[new], np.add.reduceat(value, new)
    starts = np.r_[np.flatnonzero(np.r_[True, index[1:] != index[:-1]]), len(index)]
    return names, terms, starts, code, value, order[new[starts[:-1]]]


def ascend(w, alpha, signs, starts, code, value, c, passes, seed, tolerance=None) -> None:
    """Dual coordinate ascent of one task, in place; ends early once the gap over these
    rows (``w`` is then theirs alone) is ``tolerance`` of the primal objective."""
    rng = np.random.default_rng(seed)
    square = np.add.reduceat(value * value, starts[:-1])
    mine = np.flatnonzero(signs)
    for n in range(passes):
        for i in rng.permutation(mine):
            lo, hi = starts[i], starts[i + 1]
            at, x, y = code[lo:hi], value[lo:hi], signs[i]
            new = min(max(alpha[i] + (1 - y * (x @ w[at])) / square[i], 0.0), c)
            if new != alpha[i]:
                w[at] += x * ((new - alpha[i]) * y)
                alpha[i] = new
        if tolerance is not None and n % 4 == 3:
            hinge = (np.maximum(0, 1 - signs * np.add.reduceat(value * w[code], starts[:-1])) * (signs != 0)).sum()
            if relative_gaps([w @ w], [w @ w], [hinge], [alpha.sum()], c)[0] <= tolerance:
                return


def relative_gaps(primal_squares, dual_squares, hinges, alphas, c) -> list[float]:
    """Gap over primal objective of each task; at most 0 part of it is the distance to the optimum."""
    out = []
    for p, d, h, a in zip(primal_squares, dual_squares, hinges, alphas, strict=True):
        primal = p / 2 + c * h
        out.append((primal - (a - d / 2)) / primal if primal else 0.0)
    return out


def _lists(lengths, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), values)


def _opened(signs_of: np.ndarray, c: float):
    n_tasks = signs_of.shape[1]

    def pack(rows: pa.Table) -> pa.Table:
        block = rows.column("block")[0].as_py()
        names, terms, starts, code, value, first = _by_row(rows)
        cls = rows.column("class").to_numpy()[first]
        held = np.zeros((len(names), n_tasks), bool)
        for t in range(n_tasks):
            alpha = np.zeros(len(names))
            ascend(np.zeros(len(terms)), alpha, signs_of[cls, t], starts, code, value, c, OPENING, (t, block & 0x7FFFFFFF))
            held[:, t] = alpha > 0
        n, m = len(names), len(terms)
        opened = _lists(held.sum(axis=1), pa.array(np.nonzero(held)[1].astype(np.int32)))
        lengths = np.diff(starts)

        def lists(a):
            return pa.concat_arrays([a, pa.nulls(m, a.type)])

        return pa.table({
            "block": pa.array(np.full(n + m, block), pa.int64()),
            "row": pa.concat_arrays([names, pa.nulls(m, pa.string())]),
            "class": pa.concat_arrays([pa.array(cls.astype(np.int32)), pa.nulls(m, pa.int32())]),
            "codes": lists(_lists(lengths, pa.array(code.astype(np.int32)))),
            "values": lists(_lists(lengths, pa.array(value.astype(np.float64)))),
            "opened": lists(opened),
            "term": pa.concat_arrays([pa.nulls(n, pa.string()), terms]),
            "code": pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(np.arange(m, dtype=np.int32))])})

    return pack


def _slacks(signs_of: np.ndarray):
    n_tasks = signs_of.shape[1]

    def slacks(rows: pa.Table, known: pa.Table) -> pa.Table:
        n = rows.num_rows
        if not n:
            return pa.table({"row": pa.array([], pa.string()), "u": pa.array([], pa.list_(pa.float64()))})
        codes, values = (rows.column(x).combine_chunks() for x in ("codes", "values"))
        starts = np.r_[0, np.cumsum(codes.value_lengths().to_numpy())[:-1]]
        code, value = codes.flatten().to_numpy(), values.flatten().to_numpy()
        signs = signs_of[rows.column("class").to_numpy()]
        w = np.zeros((int(code.max()) + 1, n_tasks))
        if known.num_rows:
            w[known.column("code").to_numpy()] = pc.list_flatten(known.column("v")).to_numpy().reshape(-1, n_tasks)
        u = np.zeros((n, n_tasks))
        for t in range(n_tasks):
            u[:, t] = np.maximum(0, 1 - signs[:, t] * np.add.reduceat(value * w[code, t], starts)) * (signs[:, t] != 0)
        return pa.table({"row": rows.column("row"), "u": _lists(np.full(n, n_tasks), pa.array(u.ravel()))})

    return slacks


def _solved(signs_of: np.ndarray, c: float, tolerance: float, round_: int):
    def solve(rows: pa.Table) -> pa.Table:
        task, part, parts = (rows.column(x)[0].as_py() for x in ("task", "part", "parts"))
        names, terms, starts, code, value, first = _by_row(rows)
        signs = signs_of[rows.column("class").to_numpy()[first], task]
        alpha = rows.column("alpha").to_numpy()[first].copy()
        w = np.zeros(len(terms))
        w[_ranks(rows.column("term"))[1]] = rows.column("w").to_numpy()
        before, old = w.copy(), alpha.copy()
        alone = parts == 1  # then all weights come from these rows
        ascend(w, alpha, signs, starts, code, value, c, WHOLE_PASSES << min(round_, 2) if alone else PASSES, (round_, task, part), SHARE * tolerance if alone else None)
        step = w - before
        moved, held = np.flatnonzero(step), np.flatnonzero((old > 0) | (alpha > 0))
        n, m = len(moved), len(held)
        return pa.table({
            "task": pa.array(np.full(n + m, task), pa.int32()),
            "term": pa.concat_arrays([terms.take(pa.array(moved)), pa.nulls(m, pa.string())]),
            "step": pa.concat_arrays([pa.array(step[moved]), pa.nulls(m, pa.float64())]),
            "row": pa.concat_arrays([pa.nulls(n, pa.string()), names.take(pa.array(held))]),
            "old": pa.concat_arrays([pa.nulls(n, pa.float64()), pa.array(old[held])]),
            "new": pa.concat_arrays([pa.nulls(n, pa.float64()), pa.array(alpha[held])])})

    return solve


def _per_task(name: str, n: int) -> list:
    return [F.coalesce(F.sum(F.when(F.col("task") == t, F.col(name))), F.lit(0.0)) for t in range(n)]


def fit(rows: DataFrame, signs: np.ndarray, c: float, tolerance: float, rounds: int, block_values: int) -> tuple[DataFrame, DataFrame, list[float]]:
    """Weights ``(term, w)``, dual variables ``(row, alpha)`` and the relative gaps."""
    spark, n = rows.sparkSession, signs.shape[1]
    blocks = max(1, -(-4 * rows.count() // block_values))  # a written table: read from the files' footers
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    packed = cut_lineage(blocked.groupBy("block").applyInArrow(_opened(signs, c), _PACKED), "svm-blocks")
    terms = packed.filter(F.col("term").isNotNull()).select(F.col("block").alias("home"), "term", "code")
    # dealt once; a lost executor's part is read again from the written rows
    table = packed.filter(F.col("row").isNotNull()).select("block", "row", "class", "codes", "values").repartition(blocks, "block").persist(StorageLevel.DISK_ONLY)
    chosen = packed.filter(F.col("row").isNotNull()).select("row", F.explode("opened").alias("task"), F.lit(0.0).alias("alpha"))
    weights = spark.createDataFrame([], "term string, v array<double>")
    duals = spark.createDataFrame([], "task int, row string, alpha double")
    gaps, active = [np.inf] * n, list(range(n))
    try:
        for round_ in range(rounds):
            work = cut_lineage(rows.join(chosen, "row"), "svm-work")
            sizes = {r["task"]: r["count"] for r in work.groupBy("task").count().collect()}  # one number per task
            parts = F.element_at(F.array(*[F.lit(-(-sizes.get(t, 1) // block_values)) for t in range(n)]), F.col("task") + 1)
            given = work.join(weights, "term", "left").select(
                "task", "row", "class", "term", "value", "alpha", F.coalesce(F.col("v")[F.col("task")], F.lit(0.0)).alias("w"),
                parts.alias("parts"), F.pmod(F.xxhash64("row", F.lit(round_)), parts).alias("part"))
            moved = cut_lineage(given.groupBy("task", "part").applyInArrow(_solved(signs, c, tolerance, round_), _MOVED), "svm-round")
            steps = moved.filter(F.col("term").isNotNull()).groupBy("term").agg(F.array(*_per_task("step", n)).alias("step"))
            both = cut_lineage(weights.join(steps, "term", "full").select(
                "term", *[F.coalesce(x, F.array_repeat(F.lit(0.0), n)).alias(x) for x in ("v", "step")]), "svm-step")
            w, step = ([F.col(x)[i] for i in range(n)] for x in ("v", "step"))
            products = both.agg(*[F.coalesce(F.sum(x * y), F.lit(0.0)) for x, y in [*zip(w, step), *zip(step, step)]]).first()
            changes = moved.filter(F.col("row").isNotNull()).withColumn("more", F.col("new") - F.col("old")).agg(*_per_task("more", n)).first()
            # the dual along the summed change is a parabola: its top, within the feasible part
            far = [min(1.0, max(0.0, (changes[i] - products[i]) / products[n + i])) if products[n + i] > 0 else 1.0 for i in range(n)]
            weights = cut_lineage(both.select("term", F.array(*[x + g * y for x, y, g in zip(w, step, far, strict=True)]).alias("v")), "svm-weights")
            along = F.col("old") + F.element_at(F.array(*[F.lit(g) for g in far]), F.col("task") + 1) * (F.col("new") - F.col("old"))
            duals = cut_lineage(duals.filter(~F.col("task").isin(active)).unionByName(
                moved.filter(F.col("row").isNotNull()).select("task", "row", along.alias("alpha")).filter("alpha > 0")), "svm-duals")
            known = terms.join(weights, "term").select("home", "code", "v")
            slack = cut_lineage(table.groupBy("block").cogroup(known.groupBy("home")).applyInArrow(_slacks(signs), "row string, u array<double>"), "svm-slacks")
            hinges = slack.agg(*[F.coalesce(F.sum(F.col("u")[i]), F.lit(0.0)) for i in range(n)]).first()
            squares = weights.agg(*[F.coalesce(F.sum(F.col("v")[i] * F.col("v")[i]), F.lit(0.0)) for i in range(n)]).first()
            gaps = relative_gaps(squares, squares, hinges, duals.agg(*_per_task("alpha", n)).first(), c)
            active = [t for t in range(n) if gaps[t] > tolerance]
            if not active:
                alphas = duals.groupBy("row").agg(F.array(*_per_task("alpha", n)).alias("alpha"))
                return weights.select("term", F.col("v").alias("w")), cut_lineage(alphas, "svm-alphas"), gaps
            inside = slack.select("row", F.posexplode("u").alias("task", "u")).filter("u > 0").select("row", "task", F.lit(0.0).alias("alpha"))
            chosen = inside.unionByName(duals).filter(F.col("task").isin(active)).groupBy("row", "task").agg(F.sum("alpha").alias("alpha"))
    finally:
        table.unpersist()
    raise RuntimeError(f"no convergence in {rounds} rounds: relative gaps {gaps}")
