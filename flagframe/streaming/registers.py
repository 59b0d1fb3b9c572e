"""Flag registers on streams: many writers OR their bits into one register."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_union_flags(
    stream: DataFrame,
    key: Sequence[str],
    mask: str,
    time: str,
    watermark: str,
    window: str,
    slide: str | None = None,
    session: bool = False,
    out: str = "flags",
) -> DataFrame:
    """OR of masks per key and event-time window: tumbling, sliding, or per session.

    Events later than the watermark are dropped and state behind it is released.
    Also works on a static table. A TIMESTAMP_NTZ time column is cast, as watermarks
    need TIMESTAMP; its zone is the session's.
    """
    if isinstance(stream.schema[time].dataType, T.TimestampNTZType):
        stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    if session and slide:
        raise ValueError("a session window has no slide")
    span = F.session_window(time, window) if session else F.window(time, window, slide)
    return (
        stream.withWatermark(time, watermark)
        .groupBy(span.alias("w"), *key)
        .agg(F.bit_or(mask).alias(out))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *key, out)
    )
