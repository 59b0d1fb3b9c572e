"""Session registers without a hot key, and registers that keep what came too late.

A session window gathers a key's rows in one task. Here rows are first folded per key and bucket of
time as long as the gap: rows of a bucket are less than the gap apart and so of one session, which makes this a plain
aggregation with partial results. What is left, a row per key and bucket, is stitched in
time order across range-partitioned chunks, so one key with all rows is many tasks' work in both steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flagframe.operators.ordered import carry_last, carry_sum
from flagframe.streaming.sinks import BATCH, start_stream


def _timed(df: DataFrame, time: str) -> DataFrame:
    if isinstance(df.schema[time].dataType, T.TimestampNTZType):
        return df.withColumn(time, F.col(time).cast("timestamp"))
    return df


def session_buckets(
    events: DataFrame, key: Sequence[str], mask: str, time: str, gap: str, watermark: str | None = None, out: str = "flags"
) -> DataFrame:
    """OR of masks per key and bucket of length ``gap``: key, ``bucket``, ``first``, ``last``, ``out``.

    On a stream give a ``watermark`` and write it in update mode: state is per key and bucket and is
    released behind the watermark.
    """
    timed = _timed(events, time)
    if watermark is not None:
        timed = timed.withWatermark(time, watermark)
    folded = timed.groupBy(F.window(time, gap).alias("w"), *key).agg(
        F.min(time).alias("first"), F.max(time).alias("last"), F.bit_or(mask).alias(out)
    )
    return folded.select(*key, F.col("w.start").alias("bucket"), "first", "last", out)


def stitch_sessions(buckets: DataFrame, key: Sequence[str], gap: str, out: str = "flags") -> DataFrame:
    """Sessions of ``session_buckets``: key, ``window_start``, ``window_end`` (the last time and the gap), ``out``.

    A bucket goes on with the session before it if no more than the gap lies between them, as in Spark's session windows.
    """
    key, gap_ = list(key), F.expr(f"INTERVAL {gap}")
    after = carry_last(buckets.select(*key, "first", "last", out), key, ["first"], {"_before": F.col("last")})
    fresh = F.when(F.col("first") <= F.col("_before") + gap_, 0).otherwise(1)
    numbered = carry_sum(after.withColumn("_fresh", fresh).drop("_before"), key, ["first"], {"_session": F.col("_fresh")})
    sessions = numbered.groupBy(*key, "_session").agg(F.min("first").alias("window_start"), F.max("last").alias("_last"), F.bit_or(out).alias(out))
    return sessions.select(*key, "window_start", (F.col("_last") + gap_).alias("window_end"), out)


def session_flags(events: DataFrame, key: Sequence[str], mask: str, time: str, gap: str, out: str = "flags") -> DataFrame:
    """OR of masks per key and session of a table."""
    return stitch_sessions(session_buckets(events, key, mask, time, gap, out=out), key, gap, out)


# --- registers with a table of late rows ----------------------------------------------------


def start_kept_registers(
    stream: DataFrame,
    key: Sequence[str],
    mask: str,
    time: str,
    delay: str,
    window: str,
    path: str,
    checkpoint: str,
    out: str = "flags",
    once: bool = False,
    interval: str = "10 seconds",
) -> StreamingQuery:
    """OR of masks per key and tumbling window, where rows behind the watermark are kept and counted.

    Registers merge, so a micro-batch writes its own part of each (``<path>/parts``) and needs none of the batches
    before. A row is late if its window had ended at the watermark: ``delay`` before the latest time of the batches before
    its own. Late rows go to ``<path>/late`` as they are, and ``<path>/progress`` has a row per batch:
    ``latest`` time, ``on_time`` and ``late`` rows. A batch that is repeated reads only those before it and replaces
    what it wrote. Rows without a time are late.
    """
    key, span = list(key), F.window(time, window)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark, rows = batch.sparkSession, _timed(batch, time).persist()
        mark = None
        if batch_id:
            before = spark.read.option("basePath", f"{path}/progress").parquet(*[f"{path}/progress/{BATCH}={n}" for n in range(batch_id)])
            mark = before.agg((F.max("latest") - F.expr(f"INTERVAL {delay}")).cast("string")).first()[0]
        nowhere, timed = rows.where(F.col(time).isNull()), rows.where(F.col(time).isNotNull())
        behind = F.lit(False) if mark is None else span["end"] <= F.lit(mark).cast("timestamp")
        judged = timed.withColumn("_late", behind)  # projected, as a window cannot stand in a filter
        late = judged.where("_late").drop("_late").unionByName(nowhere)
        late.write.mode("overwrite").parquet(f"{path}/late/{BATCH}={batch_id}")
        part = judged.where("NOT _late").groupBy(span.alias("w"), *key).agg(F.bit_or(mask).alias(out))
        part.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *key, out).write.mode("overwrite").parquet(
            f"{path}/parts/{BATCH}={batch_id}"
        )
        both = judged.select(time, "_late").unionByName(nowhere.select(time, F.lit(True).alias("_late")))
        counts = both.agg(F.max(time).alias("latest"), F.count(F.when(~F.col("_late"), 1)).alias("on_time"), F.count(F.when(F.col("_late"), 1)).alias("late"))
        counts.write.mode("overwrite").parquet(f"{path}/progress/{BATCH}={batch_id}")
        rows.unpersist()

    return start_stream(stream, step, checkpoint, once=once, interval=interval)


def kept_registers(spark: SparkSession, path: str, key: Sequence[str], out: str = "flags") -> DataFrame:
    """The registers of all batches: window_start, window_end, key, ``out``."""
    parts = spark.read.parquet(f"{path}/parts")
    return parts.groupBy("window_start", "window_end", *key).agg(F.bit_or(out).alias(out))


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows that came too late, with the micro-batch they came in."""
    return spark.read.parquet(f"{path}/late")
