"""File scans and checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flagframe.schemas import CHECK_RESULTS

# The file policies, as (suffix, excluded suffix, recursive).
SCAN_POLICIES = {
    "engine": (".go", "_test.go", True),
    "package": (".go", None, False),
    "project": (".go", None, True),
}


def scan_files(
    spark: SparkSession,
    root: str,
    suffix: str = "",
    exclude_suffix: str | None = None,
    recursive: bool = True,
    content: bool = True,
) -> DataFrame:
    """Files under ``root`` by suffix. Without ``content`` only names and sizes are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    files = reader.load(root)
    if exclude_suffix:
        files = files.where(~F.endswith(F.col("path"), F.lit(exclude_suffix)))
    columns = ["path", "length", "modificationTime"] + (["content"] if content else [])
    return files.select(*columns)


def scan_policy(spark: SparkSession, root: str, policy: str, content: bool = True) -> DataFrame:
    suffix, excluded, recursive = SCAN_POLICIES[policy]
    return scan_files(spark, root, suffix, excluded, recursive, content)


def package_of(path: Column) -> Column:
    """Folder of a file, as its package."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def check_files(
    files: DataFrame,
    parser: Callable[[bytes], str | None],
    mode: str = "collect",
    package: Column | None = None,
) -> DataFrame:
    """Run ``parser`` over every file; it returns an error text, or None when fine.

    Modes: ``collect`` reports each file as ``ok`` or ``error``, ``warn`` reports
    bad files as ``warning``, and ``failfast`` ends the job at the first bad file.
    """
    if mode not in ("collect", "warn", "failfast"):
        raise ValueError(f"unknown mode {mode!r}")
    bad = "warning" if mode == "warn" else "error"

    def check(content: bytes) -> str | None:
        try:
            return parser(bytes(content))
        except Exception as exc:  # a parser's own failure is a finding about the file
            return f"{type(exc).__name__}: {exc}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            errors = [check(c) for c in batch["content"]]
            if mode == "failfast":
                for path, error in zip(batch["path"], errors):
                    if error is not None:
                        raise ValueError(f"{path}: {error}")
            yield pd.DataFrame(
                {
                    "path": batch["path"],
                    "package": batch["package"],
                    "status": ["ok" if e is None else bad for e in errors],
                    "error": pd.Series(errors, dtype=object, index=batch.index),
                }
            )

    grouped = package_of(F.col("path")) if package is None else package
    return files.select("path", grouped.alias("package"), "content").mapInPandas(run, CHECK_RESULTS)


def check_rows(
    df: DataFrame, col: str, schema: str, id_cols: Sequence[str], mode: str = "collect", out: str = "status"
) -> DataFrame:
    """Check a JSON column against a schema, row by row and inside Spark's own parser.

    Adds ``status`` and ``error``; ``failfast`` raises at the first malformed row.
    """
    if mode not in ("collect", "warn", "failfast"):
        raise ValueError(f"unknown mode {mode!r}")
    full = f"{schema}, _corrupt_record string"
    parsed = F.from_json(F.col(col), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    checked = df.select(*id_cols, F.col(col).alias("_text"), parsed.alias("_parsed"))
    # The parser takes a blank text for an empty row; here it is malformed.
    blank = F.trim("_text") == ""
    bad = F.col("_text").isNotNull() & (blank | F.col("_parsed._corrupt_record").isNotNull())
    label = F.when(bad, F.lit("warning" if mode == "warn" else "error")).otherwise(F.lit("ok"))
    if mode == "failfast":
        message = F.concat(F.lit("malformed row: "), F.col("_text"))
        label = F.when(bad, F.raise_error(message).cast("string")).otherwise(F.lit("ok"))
    return checked.select(
        *id_cols,
        label.alias(out),
        F.when(bad, F.concat(F.lit("malformed: "), F.col("_text"))).alias("error"),
    )


def check_summary(checked: DataFrame, by: Sequence[str] = ("package",), status: str = "status") -> DataFrame:
    """Rows and failures per package; a package with any failure is ``failed``."""
    bad = F.count(F.when(F.col(status) != "ok", 1))
    return checked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("checked"),
        bad.alias("failed"),
        F.when(bad > 0, F.lit("failed")).otherwise(F.lit("ok")).alias("status"),
    )
