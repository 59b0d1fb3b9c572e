"""Job states folded from event logs.

Both machines are order-sensitive folds, restated so that no key is ever walked
row by row: what decides the final mask is the first terminal event, the last
start or retry before it, and whether a cancel came before or after.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flagframe.functions import bits
from flagframe.functions.bits import FlagSet
from flagframe.operators.ordered import carry_last, order_number, same_keys

# Bits of the guarded machine, from bit 0.
JOB_FLAGS = FlagSet(
    ("pending", "running", "cancel_requested", "retrying", "completed", "failed", "timed_out")
)
RUNNING, CANCEL, RETRYING = 2, 4, 8
TERMINAL_BITS = {"complete": 16, "fail": 32, "timeout": 64}

# Bits of the restartable machine, from bit 1.
RESTARTABLE_FLAGS = FlagSet(("running", "retrying", "completed", "failed", "timeout"), first_bit=1)
RESTARTABLE_BITS = {"start": 2, "complete": 8, "fail": 16, "timeout": 32}
RESTARTABLE_RETRYING = 4

_START, _RETRY, _CANCEL = 1, 2, 3


def _op_code(op: Column) -> Column:
    """Operations as small integers, so that aggregation buffers stay fixed-width."""
    code = F.when(op == "start", F.lit(_START)).when(op == "retry", F.lit(_RETRY)).when(op == "cancel", F.lit(_CANCEL))
    for name, bit in TERMINAL_BITS.items():
        code = code.when(op == name, F.lit(bit))
    return code


def job_state(events: DataFrame, key: Sequence[str], order: Sequence[str], op: str = "op") -> DataFrame:
    """Final mask per key of the guarded machine, where a terminal state absorbs.

    A single aggregation of mergeable parts: partial results form map-side, so a
    hot key is no problem, arrival order does not matter, and the same call works
    on a stream. Orders that are a number, or a time and a number, keep it a hash aggregation.
    """
    code, seq = F.col("_code"), order_number(events, list(order))
    ended = code >= TERMINAL_BITS["complete"]
    parts = (
        events.withColumn("_code", _op_code(F.col(op)))
        .groupBy(*key)
        .agg(
            F.min(F.when(ended, seq)).alias("_end_at"),
            F.min_by(code, F.when(ended, seq)).alias("_end"),
            F.min(F.when(code == _CANCEL, seq)).alias("_cancel_first"),
            F.max(F.when(code == _CANCEL, seq)).alias("_cancel_last"),
            F.max(F.when(code == _RETRY, F.lit(1))).alias("_retried"),
            F.max_by(code, F.when(code.isin(_START, _RETRY), seq)).alias("_moved"),
        )
    )
    zero = F.lit(0).cast("bigint")

    def bit(cond: Column, value: int) -> Column:
        return F.when(cond, F.lit(value).cast("bigint")).otherwise(zero)

    open_mask = bits.or_all(
        [
            bit(F.col("_moved") == _START, RUNNING),
            bit(F.col("_retried").isNotNull(), RETRYING),
            bit(F.col("_cancel_first").isNotNull(), CANCEL),
        ]
    )
    # Completing clears an earlier cancel request; failing and timing out keep it.
    kept_cancel = (F.col("_end") != TERMINAL_BITS["complete"]) & (F.col("_cancel_first") < F.col("_end_at"))
    end_mask = F.col("_end").cast("bigint").bitwiseOR(
        bit(kept_cancel | (F.col("_cancel_last") > F.col("_end_at")), CANCEL)
    )
    mask = F.when(F.col("_end_at").isNull(), open_mask).otherwise(end_mask)
    return parts.select(*key, mask.alias("mask"))


def job_history(
    events: DataFrame, key: Sequence[str], order: Sequence[str], op: str = "op", previous: DataFrame | None = None
) -> DataFrame:
    """What decides on the next event of each key: ``ended``, and the last start or retry as ``moved``.

    With ``previous``, the history before these events, the result covers both.
    """
    name, seq = F.col(op), order_number(events, list(order))
    now = events.groupBy(*key).agg(
        F.count(F.when(name.isin(*TERMINAL_BITS), 1)).alias("_ends"),
        F.max_by((name == "start").cast("int"), F.when(name.isin("start", "retry"), seq)).alias("_started"),
    )
    moved = F.when(F.col("_started") == 1, "start").when(F.col("_started") == 0, "retry")
    now = now.select(*key, (F.col("_ends") > 0).alias("ended"), moved.alias("moved"))
    if previous is None:
        return now
    # Either side has one row per key; of the texts of moves the later one counts.
    both = now.withColumn("_age", F.lit(0)).unionByName(previous.select(*key, "ended", "moved").withColumn("_age", F.lit(1)))
    return both.groupBy(*key).agg(
        F.max("ended").alias("ended"),
        F.min_by("moved", F.when(F.col("moved").isNotNull(), F.col("_age"))).alias("moved"),
    )


def job_rejections(
    events: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    op: str = "op",
    previous: DataFrame | None = None,
) -> DataFrame:
    """The events that the guarded machine refuses.

    Refused are all operations but ``cancel`` after the first terminal one, and a
    ``start`` while running. ``previous`` is the ``job_history`` of earlier events.
    """
    name = F.col(op)
    seen = carry_last(
        events,
        list(key),
        list(order),
        {
            "_moved": F.when(name.isin("start", "retry"), name),
            "_ended": F.when(name.isin(*TERMINAL_BITS), F.lit(True)),
        },
    )
    moved, ended = F.col("_moved"), F.col("_ended")
    if previous is not None:
        before = previous.select(
            *[F.col(k).alias(f"_p_{k}") for k in key], F.col("ended").alias("_p_ended"), F.col("moved").alias("_p_moved")
        )
        seen = seen.join(before, same_keys(seen, key, "_p_"), "left")
        moved, ended = F.coalesce(moved, "_p_moved"), F.coalesce(ended, "_p_ended")
    known = name.isin("start", "retry", *TERMINAL_BITS)
    refused = (known & F.coalesce(ended, F.lit(False))) | ((name == "start") & (moved == "start"))
    return seen.where(F.coalesce(refused, F.lit(False))).select(*events.columns)


def job_state_restartable(
    events: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    op: str = "op",
) -> DataFrame:
    """Final mask per key of the machine whose terminal states may restart.

    A retry counts only while running. The base bit is the last other operation;
    the retrying bit is set when the last of accepted retries and terminal
    operations is a retry. Other operations than the five known are ignored.
    """
    name = F.col(op)
    is_base = name.isin(*RESTARTABLE_BITS)
    log = events.where(is_base | (name == "retry")).select(*dict.fromkeys([*key, *order, op]))
    seen = carry_last(log, list(key), list(order), {"_base": F.when(is_base, name)})

    seq = order_number(seen, list(order))
    base_bit = F.lit(0)
    for step, value in RESTARTABLE_BITS.items():
        base_bit = F.when(name == step, F.lit(value)).otherwise(base_bit)
    accepted = (name == "retry") & F.coalesce(F.col("_base") == "start", F.lit(False))
    settles = accepted | name.isin(*TERMINAL_BITS)
    folded = (
        seen.groupBy(*key)
        .agg(
            F.max_by(base_bit, F.when(is_base, seq)).alias("_last_base"),
            F.max_by(F.when(accepted, F.lit(RESTARTABLE_RETRYING)).otherwise(F.lit(0)), F.when(settles, seq)).alias(
                "_last_retry"
            ),
        )
    )
    mask = F.coalesce(F.col("_last_base"), F.lit(0)).bitwiseOR(F.coalesce(F.col("_last_retry"), F.lit(0)))
    return folded.select(*key, mask.cast("bigint").alias("mask"))
