"""Delimited text readers under fixed schemas.

Files are read as strings under a declared schema (no schema inference:
no extra pass, no per-file drift); typed casts come afterwards.  Quoting
follows the common spreadsheet convention: ``"a ""q"" b"`` is one field and
quoted newlines stay inside the field if ``multi_line`` is asked for.  Missing-value tokens
become NULL, as a pandas reader would treat them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiframe.sources.quoted import read_quoted

# Cell texts read as missing (the default NA list of pandas'
# CSV reader).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# LIAR's fourteen positional columns.
LIAR_COLUMNS = (
    "id", "label", "statement", "subjects", "speaker", "job_title", "state", "party",
    "barely_true_n", "false_n", "half_true_n", "mostly_true_n", "pants_on_fire_n", "context",
)


def string_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


#: Column that receives the text of rows with the wrong number of cells.
MALFORMED = "_malformed"


def header_names(spark: SparkSession, path, sep: str, multi_line: bool) -> list[str]:
    """Column names of the header line of the first file (its head alone is
    read; the other files' headers are checked when they are read)."""
    first = spark.read.options(header=True, sep=sep, quote='"', escape='"', inferSchema=False, multiLine=multi_line)
    return first.csv(path).columns


def read_delimited(spark: SparkSession, path, columns: Sequence[str], sep: str = ",", header: bool = True,
                   na_tokens: Sequence[str] | None = NA_TOKENS, with_position: str | None = None,
                   multi_line: bool | str = False, malformed: str = "fail") -> DataFrame:
    """Read the named ``columns`` of CSV/TSV files as strings.

    With a header, columns are taken by name from whatever columns the files
    have; a missing one, or a file with another header, is an error.  Without, ``columns`` names all cells
    in order.  ``multi_line``: quoted fields may hold line breaks; with ``"split"``
    several tasks read a file and an unterminated quote is an error (see
    ``sources.quoted``), with True a file is one task's work, without it files are
    split and a line is a record.  ``malformed``: rows
    with too few or too many cells make the job ``fail``, are dropped
    (``drop``), or are kept with their text in ``MALFORMED`` (``keep``).
    ``with_position`` adds a dense 0-based row position in file order.
    """
    split = multi_line == "split"
    if split and with_position:
        raise ValueError("row positions need files that are read line by line or whole")
    present = header_names(spark, path, sep, multi_line is True) if header else list(columns)
    missing = [c for c in columns if c not in present]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} in {present}")
    # the whole line comes along, so that no cell can be lost or shifted without notice
    schema = string_schema([*present, MALFORMED])
    raw = read_quoted(spark, path, present, sep, header, malformed, MALFORMED) if split else (spark.read.schema(schema).option("header", header).option("sep", sep).option("multiLine", bool(multi_line))
           .option("quote", '"').option("escape", '"').option("enforceSchema", not header)
           .option("columnPruning", False)  # else only the selected cells of a row are checked
           .option("columnNameOfCorruptRecord", MALFORMED)
           .option("mode", {"fail": "FAILFAST", "drop": "DROPMALFORMED", "keep": "PERMISSIVE"}[malformed]).csv(path))
    keep = list(columns) + ([MALFORMED] if malformed == "keep" else [])
    tokens = list(na_tokens or ())
    cells = [F.when(F.col(f"`{c}`").isin(tokens), F.lit(None).cast("string")).otherwise(F.col(f"`{c}`")).alias(c)
             if tokens and c != MALFORMED else F.col(f"`{c}`") for c in keep]
    df = raw.select(*cells)
    return with_row_position(df, with_position) if with_position else df


def read_csv(spark: SparkSession, path, columns: Sequence[str], **kw) -> DataFrame:
    return read_delimited(spark, path, columns, sep=",", **kw)


def read_tsv(spark: SparkSession, path, columns: Sequence[str], **kw) -> DataFrame:
    return read_delimited(spark, path, columns, sep="\t", **kw)


def read_liar(spark: SparkSession, path, **kw) -> DataFrame:
    """Headerless 14-column LIAR TSV with positional names."""
    return read_delimited(spark, path, LIAR_COLUMNS, sep="\t", header=False, **kw)


def with_row_position(df: DataFrame, out: str = "pos") -> DataFrame:
    """Dense row position in (file, block, row) order, like ``zipWithIndex``.

    ``monotonically_increasing_id`` is not dense; it is used only inside a
    file block.  A histogram of rows per (file, block) - one row per input
    split - gives each block its offset; the planner broadcasts it or not by
    its size.
    """
    meta = df.select("*", F.col("_metadata.file_path").alias("_lf_file"),
                     F.col("_metadata.file_block_start").alias("_lf_block"),
                     F.monotonically_increasing_id().alias("_lf_mid"))
    blocks = meta.groupBy("_lf_file", "_lf_block").agg(F.count(F.lit(1)).alias("_lf_n"),
                                                       F.min("_lf_mid").alias("_lf_first"))
    before = Window.orderBy("_lf_file", "_lf_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("_lf_file", "_lf_block", "_lf_first",
                            F.coalesce(F.sum("_lf_n").over(before), F.lit(0)).alias("_lf_off"))
    joined = meta.join(offsets, ["_lf_file", "_lf_block"], "inner")
    pos = (F.col("_lf_off") + F.col("_lf_mid") - F.col("_lf_first")).cast("bigint")
    return joined.withColumn(out, pos).drop("_lf_file", "_lf_block", "_lf_mid", "_lf_first", "_lf_off")


def check_row_count(df: DataFrame, expected: int) -> DataFrame:
    """Fail the job when the row count differs (an unterminated quote swallows
    the rest of a file silently)."""
    n = df.select(F.count(F.lit(1))).scalar()
    # The check sits in a filter predicate so column pruning cannot drop it.
    ok = F.when(n == F.lit(expected), F.lit(True)).otherwise(F.raise_error(
        F.concat(F.lit(f"expected {expected} rows, read "), n.cast("string"))).cast("boolean"))
    return df.filter(ok)
