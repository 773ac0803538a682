"""Sinks: delimited and parquet tables, embedding exports, the metric log."""

from __future__ import annotations

import os
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.operators.ranking import range_rank
from lexiframe.session import cut_lineage, qualified
from lexiframe.sources.workbook import workbook_bytes

# Fixed value: schema of the metric log.
METRIC_LOG_COLUMNS = ("run", "split", "step", "epoch", "metric", "value")


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = True,
                    partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """CSV/TSV with a header and doubled quotes (``"a ""q"" b"``), no index column."""
    w = (df.write.mode(mode).option("header", header).option("sep", sep).option("quote", '"').option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def export_embeddings(df: DataFrame, path: str, tag: str, key: str, label: str, vec: str,
                      tsv_pair: bool = False) -> None:
    """Write ``(tag, key, label, embedding)`` parquet partitioned by tag; with
    ``tsv_pair`` also a vectors TSV and a metadata TSV, both numbered by line."""
    out = df.select(F.lit(tag).alias("tag"), F.col(key).alias("key"), F.col(label).cast("string").alias("label"),
                    F.col(vec).alias("embedding"))
    out.write.mode("append").partitionBy("tag").parquet(path)
    if tsv_pair:
        # numbered once, so that line n of both files is the same row whatever the ties
        ordered = range_rank(out, "key", out="pos").orderBy("pos")
        vector = F.array_join(F.transform(F.col("embedding").cast("array<double>"), lambda x: x.cast("string")), "\t")
        ordered.select(F.concat_ws("\t", F.col("pos").cast("string"), vector).alias("v")).write.mode("overwrite").text(
            f"{path}_tsv/{tag}/vectors")
        ordered.select(F.concat_ws("\t", F.col("pos").cast("string"), F.col("key").cast("string"), "label").alias("m")).write.mode(
            "overwrite").text(f"{path}_tsv/{tag}/metadata")


def read_tsv_pair(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """The exported pair, line for line: ``(pos, key, label, embedding)``."""
    cells = lambda name: spark.read.text(f"{path}_tsv/{tag}/{name}").select(F.split("value", "\t").alias("c"))
    vectors = cells("vectors").select(F.col("c")[0].cast("bigint").alias("pos"),
                                      F.slice("c", 2, F.size("c") - 1).cast("array<double>").alias("embedding"))
    meta = cells("metadata").select(F.col("c")[0].cast("bigint").alias("pos"), F.col("c")[1].alias("key"), F.col("c")[2].alias("label"))
    return meta.join(vectors, "pos")


def write_workbooks(df: DataFrame, path: str, sheet: str, columns: Sequence[str], rows_per_book: int = 5_000) -> DataFrame:
    """Write rows as XLSX workbooks (one sheet with a header line, inline
    strings, NULL cells left out) into a shared folder; returns their paths.
    A task writes what it holds, one workbook at a time."""
    names = list(columns)
    path = qualified(df.sparkSession, path)

    def run(batches):
        from pyarrow import fs

        filesystem, folder = (fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)
        filesystem.create_dir(folder, recursive=True)
        for pdf in batches:
            for lo in range(0, len(pdf), rows_per_book):
                part = pdf.iloc[lo: lo + rows_per_book]
                book = workbook_bytes(sheet, names, part[names].itertuples(index=False, name=None))
                name = f"{folder}/book-{os.urandom(8).hex()}.xlsx"
                with filesystem.open_output_stream(name) as f:
                    f.write(book)
                yield pd.DataFrame({"path": [name]})

    return cut_lineage(df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names]).mapInPandas(run, "path string"), "workbooks")


def append_metrics(df: DataFrame, path: str) -> None:
    """Append rows ``(run, split, step, epoch, metric, value)`` to the metric log."""
    df.select(F.col("run").cast("string"), F.col("split").cast("string"), F.col("step").cast("bigint"),
              F.col("epoch").cast("bigint"), F.col("metric").cast("string"),
              F.col("value").cast("double")).write.mode("append").parquet(path)
