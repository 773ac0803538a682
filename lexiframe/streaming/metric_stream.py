"""The metric log as a stream.

Training runs append scalar metrics ``(run, split, step, epoch, metric,
value)`` as files land in a folder; a Structured Streaming query appends them
to the metric table exactly once (file source + checkpointed file sink), and
the best-k / last-entry report is a batch query over that table (see
``operators.metrics.top_k_runs``).  Nothing is held in streaming state: the
log is append-only, as in the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lexiframe.operators.metrics import top_k_runs

METRIC_SCHEMA = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("step", T.LongType()),
    T.StructField("epoch", T.LongType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
])


def start_metric_log(spark: SparkSession, source_dir: str, table_dir: str, checkpoint_location: str,
                     available_now: bool = True) -> StreamingQuery:
    """Stream parquet metric files from ``source_dir`` into ``table_dir``."""
    stream = spark.readStream.schema(METRIC_SCHEMA).parquet(source_dir)
    writer = (stream.writeStream.format("parquet").option("path", table_dir)
              .option("checkpointLocation", checkpoint_location).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def best_checkpoints(spark: SparkSession, table_dir: str, metric: str, k: int = 2, mode: str = "max") -> DataFrame:
    """Top-k steps of every run by ``metric`` plus each run's last step."""
    log = spark.read.schema(METRIC_SCHEMA).parquet(table_dir)
    return top_k_runs(log.filter(log.metric == metric), "run", "step", "value", k=k, mode=mode)
