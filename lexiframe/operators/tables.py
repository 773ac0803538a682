"""Projection, renaming, filters, null handling, casts and concatenation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.functions.text import join_columns


def rename(df: DataFrame, mapping: dict | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """Rename by mapping, or give all columns new positional names."""
    if names is not None:
        return df.toDF(*names)
    return df.withColumnsRenamed(mapping or {})


def drop_columns(df: DataFrame, cols: Iterable[str] = (), from_position: int | None = None) -> DataFrame:
    """Drop named columns, or every column from 0-based ``from_position`` on."""
    out = df.drop(*cols)
    if from_position is not None:
        out = out.select(*out.columns[:from_position])
    return out


def filter_equals(df: DataFrame, col: str, value) -> DataFrame:
    return df.filter(F.col(col) == F.lit(value))


def filter_isin(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Membership filter; reaches the parquet scan as ``In(col, [...])``."""
    return df.filter(F.col(col).isin(list(values)))


def dropna_then_project(df: DataFrame, check_cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Drop rows with a NULL in any of ``check_cols`` first, then project ``keep``.

    The order matters: the NULL test covers columns that are dropped later.
    """
    return df.dropna(how="any", subset=list(check_cols)).select(*keep)


def fill_empty(df: DataFrame, value: str = "", cols: Sequence[str] | None = None) -> DataFrame:
    return df.fillna(value, subset=list(cols) if cols else None)


def concat_columns(df: DataFrame, cols: Sequence[str], out: str, sep: str = " ",
                   null_as: str | None = "") -> DataFrame:
    return df.withColumn(out, join_columns(cols, sep, null_as))


def union_by_name(*dfs: DataFrame) -> DataFrame:
    """Concatenate with duplicates kept; columns matched by name, missing -> NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def attach_by_key(df: DataFrame, other: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Add columns from ``other`` aligned on a row key (never on implicit order)."""
    return df.join(other.select(key, *cols), key, "left")


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def wide_by_position(long_df: DataFrame, key: str, position: str, value: str, positions: Sequence[int],
                     prefix: str) -> DataFrame:
    """Long ``(key, position, value)`` rows to one column per position.

    ``pivot`` is given the explicit value list so no extra job collects the
    distinct positions; ``max`` is exact because (key, position) is unique.  A
    position outside the list is an error, never dropped.
    """
    outside = F.raise_error(F.concat(F.lit(f"{position} outside the given positions: "), F.col(position).cast("string")))
    checked = F.when(F.col(position).isin(list(positions)), F.col(position)).otherwise(outside.cast(long_df.schema[position].dataType))
    wide = long_df.withColumn(position, checked).groupBy(key).pivot(position, list(positions)).agg(F.max(value))
    return wide.toDF(key, *[f"{prefix}{p}" for p in positions])
