"""Rows of a Parquet table by position, without a sort.

A table's order is that of its files by name and of the rows in each file.  Rows per
file are counted once (a scan without columns), their prefix sums give every
file its first position, and a row's position is that plus its place in the file
(``_metadata.row_index``).  Fetching by position looks the file up in the index (one
row per file, written to the shared folder) and scans that file alone; positions of
the whole table are a join with the index, so no row is shuffled.

Defined results: a position outside the table gives no rows; files without rows
have no positions; an empty table has none; columns keep their names and order.
The index describes the files it was built from: build it again when they change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiframe.session import cut_lineage

_FILE, _FIRST, _ROWS = "_lf_file", "_lf_first", "_lf_rows"


@dataclass
class PositionIndex:
    """``files``: a written table of file, first position and rows."""

    path: str
    files: DataFrame
    rows: int

    @classmethod
    def build(cls, spark: SparkSession, path: str) -> PositionIndex:
        counted = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias(_FILE)).agg(F.count(F.lit(1)).alias(_ROWS))
        counted = cut_lineage(counted, "files")
        before = Window.orderBy(_FILE).rowsBetween(Window.unboundedPreceding, -1)  # one row per file
        files = cut_lineage(counted.withColumn(_FIRST, F.coalesce(F.sum(_ROWS).over(before), F.lit(0)).cast("long")), "positions")
        return cls(path, files, files.agg(F.coalesce(F.sum(_ROWS), F.lit(0))).first()[0])

    def with_positions(self, out: str = "pos") -> DataFrame:
        """The whole table with each row's position."""
        table = self.files.sparkSession.read.parquet(self.path)
        placed = table.select("*", F.col("_metadata.file_path").alias("_lf_at"), F.col("_metadata.row_index").alias("_lf_row"))
        joined = placed.join(self.files, F.col("_lf_at") == F.col(_FILE))
        return joined.select(*[F.col(f"`{c}`") for c in table.columns], (F.col(_FIRST) + F.col("_lf_row")).alias(out))

    def rows_between(self, lo: int, hi: int, out: str = "pos") -> DataFrame:
        """Rows at positions ``lo`` to ``hi - 1``, with their positions; only the files
        that hold them are scanned."""
        spark = self.files.sparkSession
        inside = (F.col(_FIRST) < hi) & (F.col(_FIRST) + F.col(_ROWS) > lo)
        need = self.files.filter(inside).orderBy(_FIRST).select(_FILE, _FIRST).collect()  # the files of the slice
        table = spark.read.parquet(self.path)
        columns = [F.col(f"`{c}`") for c in table.columns]
        row, at = F.col("_metadata.row_index"), F.col("_metadata.file_path")
        if not need:
            return table.select(*columns, F.lit(0).cast("long").alias(out)).limit(0)
        first = F.lit(None).cast("long")
        for r in need:
            first = F.when(at == r[_FILE], F.lit(r[_FIRST])).otherwise(first)
        files = table.filter(at.isin([r[_FILE] for r in need]))
        return files.select(*columns, (first + row).alias(out)).filter(F.col(out).between(lo, hi - 1))

    def row_at(self, i: int) -> DataFrame:
        """The row at 0-based position ``i``."""
        return self.rows_between(i, i + 1, "_lf_pos").drop("_lf_pos")
