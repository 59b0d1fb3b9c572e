"""Dispatch tables: compile ordered equality rules, then look keys up."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _is_equality(rules: DataFrame) -> Column:
    ok = F.coalesce(F.col("op") == "==", F.lit(False)) & F.col("var").isNotNull()
    if "lit_kind" in rules.columns:
        ok = ok & F.coalesce(F.col("lit_kind") == "string", F.lit(False))
    return ok


def chain_prefixes(rules: DataFrame) -> DataFrame:
    """Per chain: its variable, where the compilable prefix ends, and its branches.

    The prefix ends at the first branch that is no string equality or tests another
    variable. Both are minima per (chain, variable), so the branches of a chain are
    aggregated where they lie; only the two variables seen first are compared.
    ``end_position`` is NULL when the whole chain compiles. Positions are the
    consecutive ordinals of the branches.
    """
    per_var = rules.groupBy("chain_id", "var").agg(
        F.min("position").alias("first_at"),
        F.max("position").alias("last_at"),
        F.min(F.when(~_is_equality(rules), F.col("position"))).alias("bad_at"),
    )
    chain_end = per_var.groupBy("chain_id").agg(F.max("last_at").alias("chain_end"))
    in_order = Window.partitionBy("chain_id").orderBy("first_at")
    chains = (
        per_var.withColumn("_rank", F.row_number().over(in_order))
        .withColumn("_next", F.lead("first_at").over(in_order))
        .where(F.col("_rank") == 1)
        .select("chain_id", "var", F.col("first_at").alias("start_position"), F.least("bad_at", "_next").alias("end_position"))
    )
    branches = F.coalesce(F.col("end_position"), F.col("chain_end") + 1) - F.col("start_position")
    return chains.join(chain_end, "chain_id").select(
        "chain_id", "var", "start_position", "end_position", branches.cast("bigint").alias("branches")
    )


def compile_rules(rules: DataFrame, min_branches: int = 3) -> DataFrame:
    """Lookup table ``(chain_id, var, value, action, position)`` of the compilable prefixes.

    Chains with fewer than ``min_branches`` branches in the prefix give nothing. Of
    equal values the first position wins.
    """
    prefixes = (
        chain_prefixes(rules)
        .where(F.col("branches") >= min_branches)
        .select(F.col("chain_id").alias("_chain"), F.col("var").alias("_var"), F.col("end_position"))
    )
    # Copies collapse before the chain's limit is joined on.
    entries = rules.where(_is_equality(rules)).groupBy("chain_id", "var", "value").agg(F.min("position").alias("position"))
    inside = F.col("end_position").isNull() | (F.col("position") < F.col("end_position"))
    kept = entries.join(prefixes, (F.col("chain_id") == F.col("_chain")) & (F.col("var") == F.col("_var"))).where(inside)
    actions = rules.select(F.col("chain_id").alias("_of"), F.col("position").alias("_at"), "action")
    found = kept.join(actions, (F.col("chain_id") == F.col("_of")) & (F.col("position") == F.col("_at")))
    return found.select("chain_id", "var", "value", "action", "position")


def residual_rules(rules: DataFrame, min_branches: int = 3) -> DataFrame:
    """The branches that ``compile_rules`` leaves to be tested in order."""
    prefixes = chain_prefixes(rules).select(
        F.col("chain_id").alias("_chain"), F.col("end_position"), F.col("branches")
    )
    kept = (F.col("branches") < min_branches) | (F.col("position") >= F.col("end_position"))
    return (
        rules.join(prefixes, F.col("chain_id") == F.col("_chain"))
        .where(F.coalesce(kept, F.lit(False)))
        .select(*rules.columns)
    )


def apply_rules(
    df: DataFrame,
    key: str,
    compiled: DataFrame | Mapping[str, str],
    default: str | None = None,
    out: str = "action",
    chain: str | None = None,
) -> DataFrame:
    """Exact lookup of ``key``; a miss gives ``default``.

    ``compiled`` is a mapping, the table of one chain, or, when ``chain`` names the
    column of ``df`` that holds each row's chain, the table of many. A table is
    joined without a hint: Spark broadcasts it when its measured size allows and
    otherwise splits skewed keys of a sort-merge join.
    """
    if isinstance(compiled, Mapping):
        found = F.lit(None).cast("string")
        if compiled:
            pairs = [F.lit(x) for kv in compiled.items() for x in kv]
            found = F.try_element_at(F.create_map(*pairs), F.col(key))
        return df.withColumn(out, F.coalesce(found, F.lit(default)) if default is not None else found)
    columns = [F.col("value").alias("_value"), F.col("action").alias("_action")]
    matches = F.col(key) == F.col("_value")
    if chain is not None:
        columns.append(F.col("chain_id").alias("_chain"))
        matches = matches & (F.col(chain) == F.col("_chain"))
    joined = df.join(compiled.select(*columns), matches, "left")
    action = F.when(F.col("_value").isNull(), F.lit(default)).otherwise(F.col("_action"))
    return joined.withColumn(out, action).drop("_value", "_action", "_chain")
