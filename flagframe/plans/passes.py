"""Named table-to-table passes, run in order over one lazy plan."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from flagframe.functions.bits import FlagSet
from flagframe.operators.dispatch import apply_rules
from flagframe.operators.flags import filter_flags, pack_flags, unpack_flags, update_flags
from flagframe.operators.masking import mask_literals

Pass = Callable[[DataFrame], DataFrame]

# Pass names in the order "all" runs them, with their aliases.
PASS_ALIASES = {
    "bool-to-flags": "bool2flags",
    "if-to-bitwise": "if2bitwise",
    "assign-to-bitwise": "assign2bitwise",
    "field-to-bitwise": "field2bitwise",
    "string-obfuscate": "stringobf",
    "jump-table": "jumptable",
}
ALL_PASSES = "revolution"


@dataclass(frozen=True)
class PassRun:
    """Result of a run: the final table, what ran, and which names were unknown."""

    df: DataFrame
    applied: tuple[str, ...]
    skipped: tuple[str, ...]


def resolve_passes(names: str | Sequence[str], registry: Mapping[str, Pass]) -> tuple[list[str], list[str]]:
    """Registry names to run, in order, and the names that are unknown."""
    wanted = names.split(",") if isinstance(names, str) else list(names)
    by_alias = {alias: name for name, alias in PASS_ALIASES.items()}
    run: list[str] = []
    unknown: list[str] = []
    for raw in wanted:
        name = raw.strip()
        if name == ALL_PASSES:
            run.extend(registry)
        elif name in registry:
            run.append(name)
        elif by_alias.get(name) in registry:
            run.append(by_alias[name])
        elif name:
            unknown.append(name)
    return run, unknown


def run_passes(
    df: DataFrame, names: str | Sequence[str], registry: Mapping[str, Pass], strict: bool = False
) -> PassRun:
    """Chain the named passes. Unknown names are skipped with a warning, or raise when ``strict``.

    A pass that raises ends the run.
    """
    run, unknown = resolve_passes(names, registry)
    if unknown and strict:
        raise ValueError(f"unknown passes: {', '.join(unknown)}")
    for name in unknown:
        warnings.warn(f"unknown pass skipped: {name}", stacklevel=2)
    for name in run:
        df = df.transform(registry[name])
    return PassRun(df, tuple(run), tuple(unknown))


def standard_passes(
    definitions: Mapping[str, Column | str],
    mask: str = "flags",
    condition: Mapping[str, Sequence[str]] | None = None,
    updates: tuple[DataFrame, str] | None = None,
    fields: Sequence[str] = (),
    text: Sequence[str] = (),
    rules: tuple[str, Mapping[str, str]] | None = None,
) -> dict[str, Pass]:
    """The six standard passes bound to a table's flags; what is not given does nothing.

    ``condition`` holds ``all_of``/``any_of``/``none_of``, ``updates`` a table and its
    key, ``fields`` the flags to read back, ``text`` the columns to mask and ``rules``
    a key column with its lookup.
    """
    flags = FlagSet(definitions)

    def read_fields(df: DataFrame) -> DataFrame:
        subset = [f for f in flags.names if f in fields]
        unpacked = unpack_flags(df, flags, mask, drop=False)
        return unpacked.select(*df.columns, *subset)

    def mask_text(df: DataFrame) -> DataFrame:
        for column in text:
            df = mask_literals(df, column)
        return df

    return {
        "bool-to-flags": lambda df: pack_flags(df, definitions, mask),
        "if-to-bitwise": lambda df: filter_flags(df, flags, mask, **(condition or {})),
        "assign-to-bitwise": lambda df: update_flags(df, updates[0], updates[1], mask) if updates else df,
        "field-to-bitwise": read_fields,
        "string-obfuscate": mask_text,
        "jump-table": lambda df: apply_rules(df, rules[0], rules[1]) if rules else df,
    }
