"""Watch a folder: check what arrives and append failures to an alert table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flagframe.sources.files import check_files
from flagframe.streaming.sinks import start_batches

_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def watch_folder(
    spark: SparkSession,
    root: str,
    suffix: str,
    parser: Callable[[bytes], str | None],
    alerts: str,
    checkpoint: str,
    package: Column | None = None,
    max_files: int = 1000,
    once: bool = False,
    interval: str = "10 seconds",
) -> StreamingQuery:
    """Start checking new files under ``root``; failures are appended to Parquet at ``alerts``.

    ``once`` handles what is there and stops.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema(_FILE_SCHEMA)
        .option("pathGlobFilter", f"*{suffix}")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(root)
    )
    failures = check_files(files, parser, "collect", package).where(F.col("status") != "ok")
    return start_batches(failures, alerts, checkpoint, once=once, interval=interval)
