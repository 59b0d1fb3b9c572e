"""Flag dictionaries and assignment logs as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from flagframe.functions.bits import FlagSet
from flagframe.schemas import ASSIGN_LOG, FLAG_DICTIONARY


def save_dictionary(dictionary: DataFrame, path: str, mode: str = "overwrite") -> None:
    dictionary.write.mode(mode).json(path)


def load_dictionary(spark: SparkSession, path: str, schema: str = FLAG_DICTIONARY) -> DataFrame:
    return spark.read.schema(schema).json(path)


def flag_set(dictionary: DataFrame, struct_name: str, file: str | None = None, name: str = "field") -> FlagSet:
    """The flags of one struct in bit order, to query its masks with.

    Read to the driver, as every flag becomes an expression of the plan.
    """
    own = dictionary.where(F.col("struct_name") == struct_name)
    if file is not None:
        own = own.where(F.col("file") == file)
    rows = own.select("bit", name).orderBy("bit").collect()
    if [r["bit"] for r in rows] != list(range(len(rows))):
        raise ValueError(f"the bits of struct {struct_name!r} are not consecutive; name its file")
    return FlagSet(r[name] for r in rows)


def save_assign_log(log: DataFrame, path: str, mode: str = "append") -> None:
    log.write.mode(mode).json(path)


def load_assign_log(spark: SparkSession, path: str, schema: str = ASSIGN_LOG) -> DataFrame:
    return spark.read.schema(schema).json(path)
