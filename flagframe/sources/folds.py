"""Assignment logs folded run by run.

What a log says of a key and field is its last value and the order of it. The later of two such
entries is the state of both logs, whatever order they are merged in and however often, so a run
writes the state of its own log and nothing that was folded before is read again.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flagframe.functions import bits
from flagframe.functions.bits import FlagSet

RUN = "run_id"
_RUN_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9.-]*")


def _last(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key and field: the value of the highest order, and that order. Of equal orders a true value counts."""
    order = F.col("last_order")
    # true after false at the same order, as one number: orders are integers
    rank = order.cast("decimal(20,0)") * 2 + F.coalesce(F.col("value").cast("int"), F.lit(0))
    return rows.where(order.isNotNull()).groupBy(*keys, "field").agg(F.max_by("value", rank).alias("value"), F.max(order).alias("last_order"))


def fold_log(log: DataFrame, keys: Sequence[str], field: str = "field", value: str = "value", order: str = "seq") -> DataFrame:
    """State of one log: keys, field, value, last_order. Entries without an order say nothing; orders are integers."""
    named = log.select(*keys, F.col(field).alias("field"), F.col(value).cast("boolean").alias("value"), F.col(order).cast("bigint").alias("last_order"))
    return _last(named, keys)


def save_fold(state: DataFrame, path: str, run_id: str) -> None:
    """Write a run's state into its own folder; a run that is repeated replaces what it wrote."""
    if not _RUN_NAME.fullmatch(run_id):
        raise ValueError(f"a run id has letters, digits, dots and dashes: {run_id!r}")
    state.write.mode("overwrite").parquet(f"{path}/{RUN}={run_id}")


def load_folds(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """State of all runs together: keys, field, value, last_order."""
    return _last(spark.read.option("recursiveFileLookup", "true").parquet(path), keys)


def compact_folds(spark: SparkSession, path: str, keys: Sequence[str]) -> None:
    """Merge the runs so far into one folder and remove theirs.

    The merged state is written first. If the job ends before the others are removed, they are merged
    once more by the next reader, which changes nothing.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = [status.getPath() for status in files.listStatus(folder) if status.getPath().getName().startswith(f"{RUN}=")]
    load_folds(spark, path, keys).write.parquet(f"{path}/{RUN}=merged-{uuid.uuid4().hex}")
    for old in before:
        files.delete(old, True)


def masks_of(state: DataFrame, flags: FlagSet, keys: Sequence[str], out: str = "flags") -> DataFrame:
    """One mask per key from a state, as ``fold_assignments`` gives for the whole log; any number of flags."""
    on = {n: F.max(F.when(F.col("field") == n, F.col("value"))).alias(f"_on_{n}") for n in flags.names}
    return state.groupBy(*keys).agg(*on.values()).select(*keys, bits.pack(flags, {n: F.col(f"_on_{n}") for n in flags.names}).alias(out))
