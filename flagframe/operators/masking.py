"""Literal masking and pseudonyms under a policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flagframe.functions import text as T

# The two halves of a level-3 pseudonym.
PREFIXES = ("Jf", "Kx", "Zm", "Qp", "Wv", "Bh", "Ny", "Lg")
SUFFIXES = ("8sZ", "91x", "4mP", "7vQ", "2nR", "6kL", "9wE", "3tY")


def mask_literals(df: DataFrame, col: str, type_name: Column | str = "string", out: str | None = None) -> DataFrame:
    """Text to ``type([]byte{112, 108, ...})``; short texts and stop words stay."""
    return df.withColumn(out or col, T.mask_literal(F.col(col), type_name))


def unmask_literals(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """The inverse of ``mask_literals``."""
    return df.withColumn(out or col, T.unmask_literal(F.col(col)))


def classify_literals(
    df: DataFrame,
    col: str,
    is_import: Column | str = "false",
    is_tag: Column | str = "false",
    is_constant: Column | str = "false",
    out: str = "reason",
) -> DataFrame:
    """Why each literal is kept, or ``masked``. The first reason that applies wins."""

    def given(cond: Column | str) -> Column:
        return F.coalesce(F.expr(cond) if isinstance(cond, str) else cond, F.lit(False))

    value = F.col(col)
    reason = (
        F.when(given(is_import), F.lit("import"))
        .when(given(is_tag), F.lit("tag"))
        .when(given(is_constant), F.lit("constant"))
        .when(F.octet_length(value) < T.MIN_MASKED_BYTES, F.lit("short"))
        .when(value.isin(*T.STOP_WORDS), F.lit("stop_word"))
        .otherwise(F.lit("masked"))
    )
    return df.withColumn(out, reason)


def literal_report(
    literals: DataFrame,
    col: str = "literal",
    by: Sequence[str] = ("file",),
    is_import: Column | str = "false",
    is_tag: Column | str = "false",
    is_constant: Column | str = "false",
) -> DataFrame:
    """Literals per group and reason; each masked literal counts once."""
    classified = classify_literals(literals, col, is_import, is_tag, is_constant)
    return classified.groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("literals"))


def _digest(name: Column, key: str) -> Column:
    return F.sha2(F.concat(F.lit(key), F.lit(":"), name), 256)


def _letters(name: Column, key: str) -> Column:
    """Letters and digits drawn from the keyed digest."""
    return F.regexp_replace(F.base64(F.unhex(_digest(name, key))), "[^A-Za-z0-9]", "")


def pseudonym(name: Column, level: int, key: str) -> Column:
    """The short shape of a name's pseudonym; different names may share it."""
    letters, digest = _letters(name, key), _digest(name, key)
    if level == 1:
        return F.concat(F.lower(F.substring(name, 1, 1)), F.substring(letters, 1, 4))
    if level == 2:
        return F.concat(F.substring(letters, 1, 6), F.lit("_"), F.substring(letters, 7, 2))
    if level == 3:

        def pick(words: Sequence[str], at: int) -> Column:
            index = F.conv(F.substring(digest, at, 2), 16, 10).cast("int") % len(words)
            return F.element_at(F.array(*[F.lit(w) for w in words]), index + 1)

        return F.concat(pick(PREFIXES, 1), F.substring(letters, 1, 2), F.lit("_"), pick(SUFFIXES, 3))
    return name


def pseudonymise(df: DataFrame, cols: Sequence[str], level: int, key: str) -> DataFrame:
    """Replace names by keyed pseudonyms.

    A pseudonym is a function of the name and the key alone: the shape of its level, then 128 bits of the keyed
    digest, so that distinct names stay distinct and runs, partitions and tables agree. Narrow.
    """
    if level not in (1, 2, 3):
        return df
    token = {c: F.concat(pseudonym(F.col(c), level, key), F.lit("_"), F.substring(_digest(F.col(c), key), 1, 32)) for c in cols}
    return df.withColumns(token)


# Both spellings of a control mark; within one comment "nobfuscate" wins.
def control_mark(comment: Column, prefix: str) -> Column:
    """``nobfuscate`` or ``force`` when the comment carries ``<prefix>:<mark>``, else NULL."""
    return F.when(F.contains(comment, F.lit(f"{prefix}:nobfuscate")), F.lit("nobfuscate")).when(
        F.contains(comment, F.lit(f"{prefix}:force")), F.lit("force")
    )


def mask_by_policy(
    df: DataFrame,
    marks: DataFrame,
    key: str,
    col: str,
    seq: str = "seq",
    mark: str = "mark",
    out: str | None = None,
) -> DataFrame:
    """Mask ``col`` except where the last mark of the row's key is ``nobfuscate``.

    Adds ``policy``: ``skipped`` or ``masked``.
    """
    last = (
        marks.groupBy(F.col(key).alias("_key"))
        .agg(F.max_by((F.col(mark) == "nobfuscate").cast("int"), seq).alias("_mark"))
        .where(F.col("_mark") == 1)
    )
    joined = df.join(last, F.col(key) == F.col("_key"), "left")
    keep = F.col("_mark").isNotNull()
    return (
        joined.withColumn(out or col, F.when(keep, F.col(col)).otherwise(T.mask_literal(F.col(col))))
        .withColumn("policy", F.when(keep, F.lit("skipped")).otherwise(F.lit("masked")))
        .drop("_key", "_mark")
    )


def policy_counts(masked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Masked and skipped rows per group."""
    return masked.groupBy(*by).agg(
        F.count(F.when(F.col("policy") == "masked", 1)).alias("masked"),
        F.count(F.when(F.col("policy") == "skipped", 1)).alias("skipped"),
    )
