"""Flags on tables: pack booleans into masks, query, update, aggregate and decode them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flagframe.functions import bits
from flagframe.functions.bits import FlagSet
from flagframe.operators.ordered import number_rows, order_value


def pack_flags(
    df: DataFrame,
    flags: Mapping[str, Column | str] | Sequence[str],
    out: str = "flags",
    drop: bool = True,
) -> DataFrame:
    """Replace boolean columns by one mask; flag ``i`` in the given order is bit ``i``.

    ``flags`` is a list of boolean columns or a mapping from flag name to a boolean
    expression. Columns that carry a flag's name are dropped, all others are kept.
    """
    definitions = dict(flags) if isinstance(flags, Mapping) else {f: F.col(f) for f in flags}
    packed = df.withColumn(out, bits.pack(FlagSet(definitions), definitions))
    return packed.drop(*[f for f in definitions if f in df.columns and f != out]) if drop else packed


def unpack_flags(df: DataFrame, flags: FlagSet, mask: str = "flags", drop: bool = True) -> DataFrame:
    """One boolean column per flag."""
    kept = [c for c in df.columns if not (drop and c == mask)]
    return df.select(*kept, *[bits.has_all(F.col(mask), flags, [n]).alias(n) for n in flags.names])


def filter_flags(
    df: DataFrame,
    flags: FlagSet,
    mask: str = "flags",
    all_of: Iterable[str] = (),
    any_of: Iterable[str] = (),
    none_of: Iterable[str] = (),
    definitions: Mapping[str, Column | str] | None = None,
) -> DataFrame:
    """Keep rows with all of, any of and none of the named flags.

    A predicate on a computed mask cannot reach the Parquet reader. When the mask
    comes from source columns of ``df``, pass the flag ``definitions``: the same
    condition is then stated on those columns and is pushed down.
    """
    all_of, any_of, none_of = list(all_of), list(any_of), list(none_of)
    if definitions is not None:
        source = {n: bits.as_column(definitions[n]) for n in {*all_of, *any_of, *none_of}}
        for name in all_of:
            df = df.where(source[name])
        for name in none_of:
            df = df.where(~F.coalesce(source[name], F.lit(False)))
        if any_of:
            hit = F.lit(False)
            for name in any_of:
                hit = hit | source[name]
            df = df.where(hit)
        return df
    m = F.col(mask)
    if all_of:
        df = df.where(bits.has_all(m, flags, all_of))
    if any_of:
        df = df.where(bits.has_any(m, flags, any_of))
    if none_of:
        df = df.where(bits.has_none(m, flags, none_of))
    return df


UPDATE_COLUMNS = ("set_mask", "clear_mask", "toggle_mask", "require_mask")


def _is_wide(df: DataFrame, mask: str, flags: FlagSet | None) -> bool:
    """Whether the mask is an array of words; their number is that of ``flags``."""
    wide = isinstance(df.schema[mask].dataType, T.ArrayType)
    if wide and flags is None:
        raise ValueError("a mask of several words needs its flag set")
    return wide


def update_flags(
    df: DataFrame, updates: DataFrame, key: str | Sequence[str], mask: str = "flags", flags: FlagSet | None = None
) -> DataFrame:
    """Clear, set and toggle bits per key where all ``require`` bits are present.

    ``updates`` has one row per key and any of the columns ``set_mask``,
    ``clear_mask``, ``toggle_mask`` and ``require_mask``; other keys stay unchanged.
    Wide masks are arrays of words on both sides and need ``flags``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    given = [c for c in UPDATE_COLUMNS if c in updates.columns]
    if not given:
        raise ValueError(f"updates needs at least one of {UPDATE_COLUMNS}")
    slim = updates.select(*keys, *[F.col(c).alias(f"_{c}") for c in given])
    joined = df.join(slim, keys, "left")
    operands = {c: F.col(f"_{c}") for c in given}
    if _is_wide(df, mask, flags):
        new = bits.apply_wide_update(F.col(mask), bits.n_words(flags), operands)
    else:
        new = bits.apply_update(F.col(mask), **operands).cast(df.schema[mask].dataType)
    return joined.select(*[new.alias(c) if c == mask else F.col(c) for c in df.columns])


def fold_assignments(
    log: DataFrame,
    flags: FlagSet,
    key: str | Sequence[str],
    field: str = "field",
    value: str = "value",
    order: Sequence[str] | str = "seq",
    out: str = "flags",
) -> DataFrame:
    """Final mask per key after a log of ``field = true/false`` assignments.

    The last assignment of each field counts. One aggregation with a running
    ``max_by`` per flag: partial results are merged map-side, so a hot key costs
    no more than any other.
    """
    keys = [key] if isinstance(key, str) else list(key)
    seq = order_value([order] if isinstance(order, str) else list(order))
    last = {n: F.max_by(F.col(value), F.when(F.col(field) == n, seq)).alias(f"_last_{n}") for n in flags.names}
    folded = log.groupBy(*keys).agg(*last.values())
    return folded.select(*keys, bits.pack(flags, {n: F.col(f"_last_{n}") for n in flags.names}).alias(out))


def flag_counts(df: DataFrame, flags: FlagSet, mask: str = "flags", by: Sequence[str] = ()) -> DataFrame:
    """Rows per flag and in all, and the population count, per group."""
    m = F.col(mask)
    words = bits.words_of(m, bits.n_words(flags)) if _is_wide(df, mask, flags) else [m]
    set_bits = sum((F.bit_count(w).cast("bigint") for w in words[1:]), F.bit_count(words[0]).cast("bigint"))
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.coalesce(F.sum(set_bits), F.lit(0)).cast("bigint").alias("bits_total"),
        *[F.count(F.when(bits.has_all(m, flags, [n]), 1)).alias(n) for n in flags.names],
    )
    return counts.unpivot([*by, "rows_total", "bits_total"], list(flags.names), "flag", "rows_set")


def _folded(df: DataFrame, by: Sequence[str], mask: str, out: str, flags: FlagSet | None, fold) -> DataFrame:
    """One bit aggregate per word, so that the buffers stay fixed-width."""
    if not _is_wide(df, mask, flags):
        return df.groupBy(*by).agg(fold(F.col(mask)).alias(out))
    words = bits.words_of(F.col(mask), bits.n_words(flags))
    folded = df.groupBy(*by).agg(*[fold(w).alias(f"_w{i}") for i, w in enumerate(words)])
    return folded.select(*by, F.array(*[f"_w{i}" for i in range(len(words))]).alias(out))


def union_flags(df: DataFrame, by: Sequence[str], mask: str = "flags", out: str = "flags", flags: FlagSet | None = None) -> DataFrame:
    """OR of all masks per group; independent of order and partitioning. Wide masks need ``flags``."""
    return _folded(df, by, mask, out, flags, F.bit_or)


def intersect_flags(df: DataFrame, by: Sequence[str], mask: str = "flags", out: str = "flags", flags: FlagSet | None = None) -> DataFrame:
    return _folded(df, by, mask, out, flags, F.bit_and)


def parity_flags(df: DataFrame, by: Sequence[str], mask: str = "flags", out: str = "flags", flags: FlagSet | None = None) -> DataFrame:
    return _folded(df, by, mask, out, flags, F.bit_xor)


def decode_flags(
    df: DataFrame,
    flags: FlagSet,
    mask: str = "flags",
    out: str = "flag_names",
    by_name: bool = False,
    unknown: str = "hex",
) -> DataFrame:
    """Mask to ``a|b``; see ``bits.decode`` for zero and unknown bits."""
    return df.withColumn(out, bits.decode(F.col(mask), flags, by_name=by_name, unknown=unknown))


def flags_from_map(
    df: DataFrame, map_col: str, flags: FlagSet, aliases: Mapping[str, str], out: str = "flags"
) -> DataFrame:
    """Mask from a ``map<string,boolean>`` column; a NULL map gives 0."""
    return df.withColumn(out, bits.from_map(F.col(map_col), flags, aliases))


def flag_dictionary(
    fields: DataFrame,
    struct_keys: Sequence[str] = ("file", "struct_name"),
    package: str | None = None,
    min_flags: int = 1,
) -> DataFrame:
    """One row per boolean field: flag name, bit, and the width its struct needs.

    Names are ``Flag<Struct>_<Field>``, or ``Flag<Package>_<Struct>_<Field>`` when a
    ``package`` column is named. Beyond 64 flags ``bit`` keeps counting; flag ``bit``
    lives in word ``bit div 64`` of a wide mask.
    """
    bools = fields.where(F.col("type") == "bool")
    numbered = number_rows(bools, list(struct_keys), ["pos"], "_no", "_n")
    struct = F.col("struct_name").cast("string")
    owner = struct if package is None else F.concat(F.col(package).cast("string"), F.lit("_"), struct)
    return numbered.where(F.col("_n") >= min_flags).select(
        *struct_keys,
        "field",
        F.concat(F.lit("Flag"), owner, F.lit("_"), F.col("field")).alias("flag_name"),
        (F.col("_no") - 1).cast("int").alias("bit"),
        bits.flag_width(F.col("_n")).alias("width"),
    )


def dispatch_bits(
    df: DataFrame, cases: Sequence[tuple[int, str]], mask: str = "flags", out: str = "action"
) -> DataFrame:
    """Action of the first listed bit that is set; NULL when none is."""
    wide = isinstance(df.schema[mask].dataType, T.ArrayType)
    return df.withColumn(out, bits.lowest_case(F.col(mask), cases, wide))


def stage_completion(
    df: DataFrame, key: str | Sequence[str], stage: str, n_stages: int = 3, out: str = "stages"
) -> DataFrame:
    """Stages reached per key as a mask, and whether all of them were."""
    keys = [key] if isinstance(key, str) else list(key)
    full = bits.to_signed((1 << n_stages) - 1)
    bit = F.expr(f"shiftleft(1L, cast(`{stage}` as int))")
    reached = df.groupBy(*keys).agg(F.coalesce(F.bit_or(bit), F.lit(0)).cast("bigint").alias(out))
    return reached.withColumn("complete", F.col(out).bitwiseAND(F.lit(full)) == full)


def completion_share(completed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Keys and complete keys per group."""
    return completed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("keys"),
        F.count(F.when(F.col("complete"), 1)).alias("complete_keys"),
    )
