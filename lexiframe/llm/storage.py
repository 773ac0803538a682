"""Shared-storage helpers of the training-data operators."""

from __future__ import annotations

import os
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lexiframe.session import scratch_path


#: Bytes of an Arrow batch while a table is written: each task's JVM and Python worker hold a batch of texts several times.
BATCH_BYTES, _BATCH = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder (``spark.checkpoint.dir``) and
    read it back: a recovery point that survives the loss of any executor."""
    path = scratch_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of at most ``BATCH_BYTES``; a setting that asks for fewer bytes stands."""
    before = spark.conf.get(_BATCH, None)
    if before is not None and 0 < spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) <= BATCH_BYTES:
        yield
        return
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH)
        else:
            spark.conf.set(_BATCH, before)


def open_filesystem(uri: str):
    """``(filesystem, path)`` of a shared-storage URI or an absolute path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def attempt_name(prefix: str, part: int, suffix: str) -> str:
    """A file name that no other task attempt uses; only names listed in a
    committed index are ever read, so files of failed attempts are ignored."""
    return f"{prefix}-{part:06d}-{os.urandom(6).hex()}{suffix}"


def plus(schema: StructType, **fields: str) -> StructType:
    """A new schema with more columns (``StructType.add`` changes its object,
    which a DataFrame shares)."""
    out = StructType(list(schema.fields))
    for name, kind in fields.items():
        out.add(name, kind)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps: it does so
    when the driver's garbage is collected, which may otherwise be much later."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
