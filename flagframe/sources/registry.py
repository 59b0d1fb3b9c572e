"""Module registry entries: JSON with masks and values as hexadecimal text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flagframe.functions.bits import hex_to_bigint
from flagframe.schemas import REGISTRY


def _either(field: str) -> Column:
    """A field of the entry, whether it is nested under ``control`` or not."""
    return F.coalesce(F.col(f"_r.control.{field}"), F.col(f"_r.{field}"))


def _micros(nanos: Column) -> Column:
    """Nanoseconds to microseconds in integers, floored."""
    whole = nanos - F.pmod(nanos, F.lit(1000))
    return F.call_function("div", whole, F.lit(1000))


def _parsed(df: DataFrame, json_col: str) -> DataFrame:
    return df.withColumn("_r", F.from_json(F.col(json_col), REGISTRY))


def decode_registry(df: DataFrame, json_col: str, id_cols: Sequence[str]) -> DataFrame:
    """One row per entry, masks decoded to BIGINT and the epoch to a timestamp."""
    parsed = _parsed(df, json_col)
    return parsed.select(
        *id_cols,
        _either("schema_version").alias("schema_version"),
        _either("ipc.type").alias("ipc_type"),
        _either("ipc.socket").alias("ipc_socket"),
        _either("ipc.mode").alias("ipc_mode"),
        _either("bitreg.brf_path").alias("brf_path"),
        _either("bitreg.ns_bits").alias("ns_bits"),
        _either("bitreg.policy").alias("policy"),
        hex_to_bigint(_either("bitreg.cap_mask")).alias("cap_mask"),
        hex_to_bigint(_either("bitreg.state_hex")).alias("state"),
        _either("kv.encoding").alias("encoding"),
        F.coalesce(F.size(_either("kv.declare_hashes")), F.lit(0)).alias("declared"),
        _either("seq").alias("seq"),
        F.timestamp_micros(_micros(_either("epoch_ns"))).alias("epoch"),
    )


def registry_values(df: DataFrame, json_col: str, id_cols: Sequence[str]) -> DataFrame:
    """One row per key-value pair of each entry, decoded to BIGINT."""
    parsed = _parsed(df, json_col)
    exploded = parsed.select(
        *id_cols, _either("kv.declare_hashes").alias("_declared"), F.explode(_either("kv.values")).alias("_kv")
    )
    return exploded.select(
        *id_cols,
        hex_to_bigint(F.col("_kv.key_hash")).alias("key_hash"),
        hex_to_bigint(F.col("_kv.u64_hex")).alias("value"),
        F.coalesce(
            F.exists("_declared", lambda d: d["key_hash"] == F.col("_kv.key_hash")), F.lit(False)
        ).alias("declared"),
    )


def read_registry(spark, path: str) -> DataFrame:
    """Registry files of a folder, one row per file: ``module``, ``body``.

    Files are named ``control_<module>.json``; other names keep their stem.
    """
    files = spark.read.text(path, wholetext=True).withColumn("_path", F.col("_metadata.file_path"))
    stem = F.regexp_extract("_path", r"([^/]+)\.json$", 1)
    return files.select(F.regexp_replace(stem, "^control_", "").alias("module"), F.col("value").alias("body"))
