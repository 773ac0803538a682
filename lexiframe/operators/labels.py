"""Label maps: fit once, encode, decode.

A label map is a small DataFrame ``(label STRING, label_id INT)``.  It is fit
once (on the training rows) and applied to every split, so ids never depend on
which file a split came from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiframe.session import cut_lineage

# The seven X-Fact classes and their ids.
XFACT_LABELS = {
    "true": 0,
    "false": 1,
    "partly true/misleading": 2,
    "mostly false": 3,
    "mostly true": 4,
    "complicated/hard to categorise": 5,
    "other": 6,
}


def distinct_labels(df: DataFrame, label: str, pos: str | None = None) -> DataFrame:
    """Distinct labels with the position of their first appearance (if ``pos``)."""
    if pos is None:
        return df.select(label).distinct()
    return df.groupBy(label).agg(F.min(pos).alias("first_pos"))


def fit_label_map(df: DataFrame, label: str, pos: str | None = None,
                  order: str = "first_seen", materialize: bool = True) -> DataFrame:
    """``(label, label_id)`` with ids by first appearance or alphabetically.

    ``first_seen`` needs ``pos``: ids follow ``min(pos)`` per label.  The
    grouped table has one row per class, so the final numbering runs over a
    class-sized table.
    """
    if order == "first_seen":
        if pos is None:
            raise ValueError("order='first_seen' needs a position column")
        firsts = distinct_labels(df, label, pos)
        w = Window.orderBy("first_pos", label)
    elif order == "alphabetical":
        firsts = df.select(label).distinct()
        w = Window.orderBy(label)
    else:
        raise ValueError(f"unknown order {order!r}")
    out = firsts.select(F.col(label).alias("label"), (F.row_number().over(w) - 1).cast("int").alias("label_id"))
    # Fitting is an action: the map is written once to the shared folder, so
    # later joins see its real (class-sized) file size and the planner
    # broadcasts it by that measured size, or shuffles when it is large.
    return cut_lineage(out, "label-map") if materialize else out


def fixed_label_map(spark: SparkSession, mapping: dict) -> DataFrame:
    rows = sorted(mapping.items(), key=lambda kv: kv[1])
    return spark.createDataFrame(rows, "label string, label_id int")


def encode_labels(df: DataFrame, label_map: DataFrame, label: str = "label", out: str = "label_id",
                  on_unknown: str = "error") -> DataFrame:
    """Attach ``out`` by looking ``label`` up in the map.

    ``on_unknown``: ``error`` fails the job on a label missing from the map (the
    reference's dict lookup raises), ``keep`` leaves NULL, ``skip`` drops the row.
    The map is joined without a hint: a fitted (written) map is broadcast by
    the planner's size check; a large one is shuffle-joined with AQE skew
    splitting, so a hot label does not land in one task.
    """
    lm = label_map.select(F.col("label").alias("_lf_label"), F.col("label_id").alias(out))
    how = "inner" if on_unknown == "skip" else "left"
    joined = df.join(lm, df[label].cast("string") == lm["_lf_label"], how).drop("_lf_label")
    if on_unknown == "error":
        joined = joined.withColumn(
            out,
            F.when(F.col(out).isNull() & F.col(label).isNotNull(),
                   F.raise_error(F.concat(F.lit("label not in map: "), F.col(label).cast("string"))).cast("int"))
            .otherwise(F.col(out)))
    return joined


def decode_labels(df: DataFrame, label_map: DataFrame, id_col: str = "label_id", out: str = "label") -> DataFrame:
    lm = label_map.select(F.col("label_id").alias("_lf_id"), F.col("label").alias(out))
    return df.join(lm, df[id_col] == lm["_lf_id"], "left").drop("_lf_id")
