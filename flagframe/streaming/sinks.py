"""Parquet sinks for streams in any output mode."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch_id"


def start_stream(
    stream: DataFrame,
    step: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    once: bool = False,
    interval: str = "10 seconds",
) -> StreamingQuery:
    """Run ``step`` on every micro-batch. ``once`` handles what is there and stops."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(step)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


def start_batches(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    mode: str = "append",
    once: bool = False,
    interval: str = "10 seconds",
) -> StreamingQuery:
    """Write every micro-batch to its own ``batch_id`` partition of ``path``.

    A batch that is repeated after a failure replaces its partition, so nothing is
    written twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return start_stream(stream, write, checkpoint, mode, once, interval)


def latest_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last version of each key among the batches of an update-mode stream."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, BATCH)]
    last = rows.groupBy(*keys).agg(*[F.max_by(c, BATCH).alias(c) for c in values])
    return last.select(*[c for c in rows.columns if c != BATCH])
