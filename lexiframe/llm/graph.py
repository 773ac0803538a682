"""Connected components by repeated contraction, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.storage import written

#: Rounds after which an unfinished contraction is an error (each at least halves the nodes that have a smaller neighbour).
MOST_ROUNDS = 64


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, label)`` of every node with an edge; the label is the smallest
    node of its component.

    Every round each node hooks onto its smallest neighbour, the hooks are
    followed twice, and the edges are rewritten between hooks; a star of any
    size vanishes in one round, by minima that are pre-aggregated in each task.
    All tables stay distributed and every round is written, so that a lost
    executor costs one round at most."""
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u is not null and v is not null")
    live = written(pairs.filter("u <> v").distinct(), "edges")
    labels = None
    for _ in range(MOST_ROUNDS):
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")), "hooks")
        up = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        hook = written(hook.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p")), "hooks")
        if labels is None:
            labels = hook.select(F.col("u").alias("node"), F.col("p").alias("label"))
        else:
            at = hook.select(F.col("u").alias("label"), "p")
            labels = labels.join(at, "label", "left").select("node", F.coalesce("p", "label").alias("label"))
        labels = written(labels, "labels")
        to_u, to_v = hook.select("u", F.col("p").alias("pu")), hook.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        live = written(live.join(to_u, "u").join(to_v, "v").filter("pu <> pv").select(
            F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct(), "edges")
        if live.isEmpty():
            return labels
    raise RuntimeError("contraction did not finish")
