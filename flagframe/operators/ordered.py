"""Order-dependent work per key that stays parallel when one key is huge.

A window per key puts the whole key into one task. Here the rows are range-partitioned
once by keys and order and written, with the number of their partition as a
chunk, so that every reader sees the same borders. Windows run per key and chunk.
What crosses a chunk border (a count, the last value seen) is carried on: at
most one key crosses each border, so the carried table has at most a row per partition.
Any sortable order works alike, and equal keys and orders lie in one chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flagframe.session import staged

CHUNK = "_chunk"


def order_value(order: Sequence[str]) -> Column:
    """One comparable column for an order of one or more columns."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def order_number(df: DataFrame, order: Sequence[str]) -> Column:
    """An order as one fixed-width number where its columns allow, so that aggregations on it stay hashed.

    A time before an integer becomes microseconds * 10^19 + integer; other orders are structs.
    """
    kinds = [df.schema[c].dataType for c in order]
    times, integers = (T.TimestampType, T.TimestampNTZType), (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
    if len(order) == 2 and isinstance(kinds[0], times) and isinstance(kinds[1], integers):
        micros = F.unix_micros(F.col(order[0]).cast("timestamp")).cast("decimal(19,0)")
        # 19 digits for the time, 19 for the integer
        return (micros * F.lit("10000000000000000000").cast("decimal(20,0)")).cast("decimal(38,0)") + F.col(order[1]).cast("decimal(19,0)")
    return order_value(order)


def same_keys(df: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of ``keys`` with the prefixed columns of a joined table."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & df[k].eqNullSafe(F.col(f"{prefix}{k}"))
    return cond


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``_chunk``, ascending in (keys, order); the table is written once."""
    return staged(df.repartitionByRange(*keys, *order).withColumn(CHUNK, F.spark_partition_id()), "chunks")


def _spanning(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that lie in more than one chunk, prefixed ``_s_``: one per border at most."""
    spans = rows.groupBy(*keys).agg(F.min(CHUNK).alias("_lo"), F.max(CHUNK).alias("_hi")).where("_lo < _hi")
    return staged(spans.select(*[F.col(k).alias(f"_s_{k}") for k in keys]), "spanning-keys")


def _carried(rows: DataFrame, keys: Sequence[str], parts: Mapping[str, Column], values: Mapping[str, Column]) -> DataFrame:
    """Attach to the rows of spanning keys what ``values`` say of their chunks' ``parts``."""
    inside = rows.join(_spanning(rows, keys), same_keys(rows, keys, "_s_"), "left_semi")
    chunks = inside.groupBy(*keys, CHUNK).agg(*[c.alias(n) for n, c in parts.items()])
    groups = [*keys, CHUNK]
    table = staged(chunks.select(*[F.col(g).alias(f"_c_{g}") for g in groups], *[c.alias(n) for n, c in values.items()]), "carried")
    return rows.join(table, same_keys(rows, groups, "_c_"), "left").drop(*[f"_c_{g}" for g in groups])


def _earlier(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def carry_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """Per row, the last non-NULL ``value`` strictly before it in the order of its key."""
    rows = chunked(df.withColumns({f"_v_{n}": v for n, v in values.items()}), keys, order)
    seq = order_value(order)
    tails = {f"_t_{n}": F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), seq)) for n in values}
    carried = {f"_from_{n}": F.last(f"_t_{n}", ignorenulls=True).over(_earlier(keys)) for n in values}
    out = _carried(rows, keys, tails, carried)
    before = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = {n: F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(before), F.col(f"_from_{n}")).alias(n) for n in values}
    return out.select(*df.columns, *found.values())


def carry_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """Per row, the sum of each value over the rows of its key up to and with it; rows of equal order come in any order."""
    rows = chunked(df.withColumns({f"_v_{n}": F.coalesce(v, F.lit(0)).cast("bigint") for n, v in values.items()}), keys, order)
    sums = {f"_t_{n}": F.sum(f"_v_{n}") for n in values}
    carried = {f"_from_{n}": F.sum(f"_t_{n}").over(_earlier(keys)) for n in values}
    out = _carried(rows, keys, sums, carried)
    to_here = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = [(F.sum(f"_v_{n}").over(to_here) + F.coalesce(f"_from_{n}", F.lit(0))).alias(n) for n in values]
    return out.select(*df.columns, *found)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "row_no", total: str | None = None) -> DataFrame:
    """1-based row number per key and, on request, the number of rows of the key."""
    rows = chunked(df, keys, order)
    group = Window.partitionBy(*keys, CHUNK)
    whole = Window.partitionBy(*keys)
    values = {"_n_before": F.sum("_n").over(_earlier(keys)), "_n_all": F.sum("_n").over(whole)}
    joined = _carried(rows, keys, {"_n": F.count(F.lit(1))}, values)
    row_no = F.row_number().over(group.orderBy(*order)) + F.coalesce("_n_before", F.lit(0))
    size = F.coalesce("_n_all", F.count(F.lit(1)).over(group))
    return joined.select(*df.columns, row_no.cast("bigint").alias(out), *([size.alias(total)] if total else []))
