"""In-batch pairs and the supervised contrastive loss.

For a batch of vectors z (L2-normalised) with labels y and temperature tau:
    s_ij   = <z_i, z_j> / tau                            (i != j)
    lse_i  = log sum_{k != i} exp(s_ik)                  (max subtracted first)
    loss_i = -(1 / P_i) sum_{j != i, y_j = y_i} (s_ij - lse_i),  0 if P_i = 0
    loss   = mean_i loss_i                               (per batch)
A batch has at most B rows.  Pairs come from a self-join on the batch id, which
emits at most B - 1 partners per row; the loss is computed on one array per
batch.  The masks are built from each batch's own labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.functions.vectors import dot, l2_normalize, logsumexp

# Fixed value: default temperature of the loss.
DEFAULT_TEMPERATURE = 0.1


def in_batch_pairs(df: DataFrame, batch: str, pos: str, label: str, vec: str,
                   temperature: float | None = None, normalize: bool = True) -> DataFrame:
    """``(batch, a_pos, b_pos, a_label, same_label, sim)`` for all i != j of each batch.

    ``sim`` is the cosine (dot of normalised vectors), divided by
    ``temperature`` when one is given.
    """
    v = l2_normalize(vec) if normalize else F.col(vec)
    base = df.select(F.col(batch).alias("_lf_b"), F.col(pos).alias("_lf_p"), F.col(label).alias("_lf_y"),
                     v.alias("_lf_v"))
    a = base.select(F.col("_lf_b").alias(batch), F.col("_lf_p").alias("a_pos"), F.col("_lf_y").alias("a_label"),
                    F.col("_lf_v").alias("a_vec"))
    b = base.select(F.col("_lf_b").alias(batch), F.col("_lf_p").alias("b_pos"), F.col("_lf_y").alias("b_label"),
                    F.col("_lf_v").alias("b_vec"))
    pairs = a.join(b, batch, "inner").filter(F.col("a_pos") != F.col("b_pos"))
    sim = dot("a_vec", "b_vec")
    if temperature is not None:
        sim = sim / F.lit(float(temperature))
    return pairs.select(batch, "a_pos", "b_pos", "a_label", (F.col("a_label") == F.col("b_label")).alias("same_label"),
                        sim.alias("sim"))


def supcon_per_anchor(df: DataFrame, batch: str, pos: str, label: str, vec: str,
                      temperature: float = DEFAULT_TEMPERATURE) -> DataFrame:
    """``(batch, pos, n_pos, loss)`` per anchor; anchors alone in a batch get 0.

    The rows of a batch (at most its size) meet in one array, in one exchange,
    and all similarities are computed inside that row."""
    item = F.struct(F.col(pos).alias("p"), F.col(label).alias("y"), l2_normalize(vec).alias("z"))
    rows = df.groupBy(batch).agg(F.sort_array(F.collect_list(item)).alias("_lf_items"))
    # per anchor: (same label, similarity) of every other row
    others = F.transform("_lf_items", lambda a, i: F.struct(a["p"].alias("p"), F.filter(F.transform(
        "_lf_items", lambda b, j: F.struct(j.alias("j"), (a["y"] == b["y"]).alias("same"),
                                           (dot(a["z"], b["z"]) / F.lit(float(temperature))).alias("s"))),
        lambda x: x["j"] != i).alias("o")))
    rows = rows.select(batch, F.explode(others).alias("_lf_a")).select(batch, F.col("_lf_a.p").alias(pos), F.col("_lf_a.o").alias("_lf_o"))
    sims = F.transform("_lf_o", lambda x: x["s"])
    same = F.filter("_lf_o", lambda x: x["same"])
    total = F.aggregate(same, F.lit(0.0), lambda acc, x: acc + x["s"])
    rows = rows.select(batch, pos, F.size(same).cast("long").alias("n_pos"), total.alias("_lf_sum"),
                       F.when(F.size("_lf_o") > 0, logsumexp(sims)).alias("_lf_lse"))
    loss = -(F.col("_lf_sum") - F.col("n_pos") * F.col("_lf_lse")) / F.col("n_pos")
    return rows.select(batch, pos, "n_pos", F.when(F.col("n_pos") > 0, loss).otherwise(F.lit(0.0)).alias("loss"))


def supcon_loss(df: DataFrame, batch: str, pos: str, label: str, vec: str,
                temperature: float = DEFAULT_TEMPERATURE) -> DataFrame:
    """``(batch, n, loss)``: mean anchor loss per batch."""
    per = supcon_per_anchor(df, batch, pos, label, vec, temperature)
    return per.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("loss"))


def contrastive_views(df: DataFrame, key: str, text: str, augmented: str, label: str,
                      out_text: str = "text") -> DataFrame:
    """Two rows per input: view 0 = original text, view 1 = its augmentation,
    both with the row's label (and any batch column carried along)."""
    carry = [c for c in df.columns if c not in (text, augmented)]
    views = F.explode(F.array(F.struct(F.lit(0).alias("view"), F.col(text).alias(out_text)),
                              F.struct(F.lit(1).alias("view"), F.col(augmented).alias(out_text))))
    return df.select(*carry, views.alias("_lf_v")).select(*carry, "_lf_v.view", f"_lf_v.{out_text}")
