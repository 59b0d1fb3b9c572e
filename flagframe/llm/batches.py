"""Bounded reading in Python workers: small slices of Arrow batches, and memory given back at a task's end."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_ROWS = 256
BATCH_BYTES = 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold some MB: by default they hold 10,000 texts or 64 MB.

    A batch lies in the JVM's buffers and in the worker's at once, and both keep what they once took.
    The setting stays for the session, as plans read it when they run; one that is set already is kept.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_BYTES))
    return df


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, few at a time, so that few texts are Python strings at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Return freed memory of this worker to the system; workers wait for their next task with what they hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` over few rows at a time, with its memory given back when the task ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(sliced(batches))
        finally:
            give_back()

    return whole
