"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this package expects.  AQE re-plans joins against
# runtime sizes (small derived tables become broadcasts only when they really
# are small) and splits skewed shuffle partitions.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "lexiframe", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a folder every executor can reach and is
    read from the session.  Only under a ``local`` master, where driver and
    executors are one process, is a temporary folder made when neither the
    setting nor the context's checkpoint folder exists; any other master
    without a shared folder is an error, because executors would write to
    disks of their own.  The temporary folder goes when the process ends.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
        path = tempfile.mkdtemp(prefix="lexiframe-ckpt-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(path)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme Spark resolves it by, so that code in tasks which opens
    files itself sees the same file system (a path without one is not the executor's own disk)."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(there).toString()


def scratch_root(spark: SparkSession) -> str:
    """This application's sub-folder of the shared checkpoint folder, with its scheme."""
    return f"{qualified(spark, checkpoint_dir(spark)).rstrip('/')}/lexiframe/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written table."""
    return f"{scratch_root(spark)}/{name}-{os.urandom(6).hex()}"


def clear_scratch(spark: SparkSession) -> bool:
    """Delete what this application wrote below ``scratch_root``; call it once
    no result that was built from those tables is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as parquet into the shared checkpoint folder and read
    it back: the lineage is cut and the data survives executor loss.

    (A reliable ``checkpoint()`` of an uncached Dataset computes it twice:
    once for the action and once more to write the checkpoint files.)
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
