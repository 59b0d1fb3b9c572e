"""Job states on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flagframe.operators.state import job_history, job_rejections, job_state
from flagframe.streaming.sinks import BATCH, start_stream


def stream_job_state(stream: DataFrame, key: Sequence[str], order: Sequence[str], op: str = "op") -> DataFrame:
    """The guarded job state, kept up to date by a stream; write it in update mode.

    The state is an aggregation whose parts merge in any order, so events may come
    late or out of order and the mask still equals the batch result. State is kept
    per key for good: a job has no natural end in event time.
    """
    return job_state(stream, key, order, op)


def _history_before(spark: SparkSession, path: str, batch_id: int, key: Sequence[str], every: int) -> DataFrame | None:
    """History of all batches before ``batch_id``: the last snapshot and what changed since."""
    if batch_id == 0:
        return None
    snapshot = (batch_id - 1) // every * every
    parts = [f"{path}/{BATCH}={n}" for n in range(snapshot, batch_id)]
    changes = spark.read.option("basePath", path).parquet(*parts)
    return changes.groupBy(*key).agg(F.max_by("ended", BATCH).alias("ended"), F.max_by("moved", BATCH).alias("moved"))


def start_job_rejections(
    stream: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    path: str,
    checkpoint: str,
    op: str = "op",
    once: bool = False,
    interval: str = "10 seconds",
    snapshot_every: int = 20,
) -> StreamingQuery:
    """Write the refused events of a stream to ``<path>/rows``, one partition per micro-batch.

    Each micro-batch goes through the batch operator, so a hot key is split there as
    well. Within a micro-batch events are sorted by ``order``; an event of a later
    batch is taken as later. ``<path>/history`` keeps what the next batch needs of
    each key, as changes with a full snapshot every ``snapshot_every`` batches. A
    batch that is repeated after a failure reads only the history before it and
    replaces what it wrote. Only one query may write to a path at a time.
    """
    key, order = list(key), list(order)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark, history = batch.sparkSession, f"{path}/history"
        events = batch.select(*dict.fromkeys([*key, *order, op])).persist()
        previous = _history_before(spark, history, batch_id, key, snapshot_every)
        refused = job_rejections(events, key, order, op, previous)
        refused.write.mode("overwrite").parquet(f"{path}/rows/{BATCH}={batch_id}")
        now = job_history(events, key, order, op, previous)
        if batch_id % snapshot_every:
            touched = events.select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()
            now = now.join(touched, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key], "left_semi")
        now.write.mode("overwrite").parquet(f"{history}/{BATCH}={batch_id}")
        events.unpersist()

    return start_stream(stream, step, checkpoint, once=once, interval=interval)


def as_job_events(events: DataFrame, op_of: dict[str, str], kind: str, op: str = "op") -> DataFrame:
    """Name the operation of each event; kinds without one are dropped."""
    name = F.lit(None).cast("string")
    for value, operation in op_of.items():
        name = F.when(F.col(kind) == value, F.lit(operation)).otherwise(name)
    return events.withColumn(op, name).where(F.col(op).isNotNull())
