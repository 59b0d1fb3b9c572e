"""Findings, summaries, comparisons, overlays, checksums and versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from flagframe.functions import text as T
from flagframe.operators.corpus import is_simple

# The estimates reported per finding.
BYTES_SAVED_PER_FLAG = 7
SPEEDUP_PER_STRUCT = 2.5

# Size of a boolean field and of a packed mask, in bytes.
BOOL_BYTES = 1
MASK_BYTES = 8


def findings(candidates: DataFrame) -> DataFrame:
    """One conversion finding per candidate struct (an estimate of 7 bytes per flag)."""
    n = F.col("bool_fields")
    return candidates.select(
        "file",
        F.lit("BitfieldConversion").alias("type"),
        F.concat(
            F.lit("Convert "),
            n.cast("string"),
            F.lit(" bool fields to bitwise flags in struct "),
            F.col("struct_name").cast("string"),
        ).alias("description"),
        F.concat_ws(":", "file", F.col("line").cast("string")).alias("location"),
        (n * BYTES_SAVED_PER_FLAG).cast("bigint").alias("bytes_saved"),
        F.lit(SPEEDUP_PER_STRUCT).alias("speedup"),
        F.concat(
            F.lit("Obfuscated struct "), F.col("struct_name").cast("string"), F.lit(" with bitwise operations")
        ).alias("security_description"),
        F.lit("Medium").alias("security_strength"),
    )


def summarise(found: DataFrame) -> DataFrame:
    """One row over all findings; the mean speedup of nothing is 1.0."""
    per_file = found.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("bytes_saved").alias("bytes"),
        F.sum("speedup").alias("speedup"),
        F.count("security_strength").alias("security"),
    )
    return per_file.agg(
        F.count(F.lit(1)).alias("files_analyzed"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_optimizations"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("estimated_bytes_saved"),
        F.coalesce(F.sum("speedup") / F.sum("n"), F.lit(1.0)).alias("average_speedup_factor"),
        F.coalesce(F.sum("security"), F.lit(0)).alias("security_features"),
    )


def project_stats(files: DataFrame, contexts: DataFrame, outcome: DataFrame) -> DataFrame:
    """Counters over a run: files, contexts found, files and contexts transformed, errors.

    ``files(file)`` has distinct rows, ``contexts(file)`` one row per context and
    ``outcome(file, transformed[, error])`` one row per processed file. All contexts
    of a transformed file count as transformed.
    """
    per_file = contexts.groupBy(F.col("file").alias("_cfile")).agg(F.count(F.lit(1)).alias("_contexts"))
    error = F.col("error") if "error" in outcome.columns else F.lit(None).cast("string")
    result = outcome.select(F.col("file").alias("_ofile"), F.col("transformed").alias("_done"), error.alias("_error"))
    joined = (
        files.select("file")
        .join(per_file, F.col("file") == F.col("_cfile"), "left")
        .join(result, F.col("file") == F.col("_ofile"), "left")
    )
    done = F.coalesce(F.col("_done"), F.lit(False)) & F.col("_contexts").isNotNull()
    return joined.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count("_contexts").alias("files_with_contexts"),
        F.count(F.when(done, 1)).alias("transpiled_files"),
        F.coalesce(F.sum("_contexts"), F.lit(0)).alias("contexts_found"),
        F.coalesce(F.sum(F.when(done, F.col("_contexts"))), F.lit(0)).alias("contexts_transpiled"),
        F.count("_error").alias("errors"),
    )


def project_issues(outcome: DataFrame) -> DataFrame:
    """The errors behind ``project_stats``, one row each."""
    return outcome.where(F.col("error").isNotNull()).select("file", "error")


def size_estimate(dictionary: DataFrame, row_counts: DataFrame, struct: str = "struct_name") -> DataFrame:
    """Bytes before and after packing per struct, one byte per boolean.

    ``reduction_pct`` is floored at 0 and NULL without flags.
    """
    flags = dictionary.groupBy(F.col(struct).alias("_struct")).agg(F.count(F.lit(1)).alias("_n"))
    joined = row_counts.join(flags, F.col(struct) == F.col("_struct"), "left")
    n = F.coalesce("_n", F.lit(0)).cast("bigint")
    before = n * BOOL_BYTES
    reduction = F.when(
        n > 0, F.greatest(F.lit(0.0), (before - MASK_BYTES).cast("double") / before * F.lit(100.0))
    )
    return joined.select(
        struct,
        n.alias("flags"),
        "rows",
        (before * F.col("rows")).alias("bytes_before"),
        (F.lit(MASK_BYTES) * F.col("rows")).cast("bigint").alias("bytes_after"),
        reduction.alias("reduction_pct"),
    )


def overlay(original: DataFrame, generated: DataFrame, key: str, value: str) -> DataFrame:
    """Every original row, its value replaced where a generated one exists.

    ``generated`` has one row per key; its NULL values count as failed and keep the
    original, and keys that only it has are ignored. ``origin`` tells which was used.
    """
    new = generated.where(F.col(value).isNotNull()).select(
        F.col(key).alias("_key"), F.col(value).alias("_value")
    )
    joined = original.join(new, F.col(key) == F.col("_key"), "left")
    replaced = F.col("_key").isNotNull()
    return (
        joined.withColumn(value, F.when(replaced, F.col("_value")).otherwise(F.col(value)))
        .withColumn("origin", F.when(replaced, F.lit("generated")).otherwise(F.lit("original")))
        .drop("_key", "_value")
    )


def is_entry_file(path: Column) -> Column:
    """Files whose structure is preserved."""
    base = F.substring_index(path, "/", -1)
    return (
        (base == "main.go")
        | F.contains(path, F.lit("cmd/main.go"))
        | F.contains(path, F.lit("main/main.go"))
        | F.endswith(path, F.lit("_main.go"))
    )


def route_files(
    files: DataFrame, contexts: DataFrame, path: str = "file", preserve: Column | None = None
) -> DataFrame:
    """``copy`` without contexts, else ``preserve`` for entry files and ``transform``."""
    counts = contexts.groupBy(F.col("file").alias("_cfile")).agg(F.count(F.lit(1)).alias("_n"))
    joined = files.join(counts, F.col(path) == F.col("_cfile"), "left")
    entry = is_entry_file(F.col(path)) if preserve is None else preserve
    route = (
        F.when(F.col("_n").isNull(), F.lit("copy")).when(entry, F.lit("preserve")).otherwise(F.lit("transform"))
    )
    return (
        joined.withColumn("contexts", F.coalesce("_n", F.lit(0)).cast("bigint"))
        .withColumn("route", route)
        .drop("_n", "_cfile")
    )


def preserved_annotations(routed: DataFrame, contexts: DataFrame, path: str = "file") -> DataFrame:
    """Notes for preserved files: their eligible, simple contexts."""
    kept = routed.where(F.col("route") == "preserve").select(F.col(path).alias("_pfile"))
    deps = F.col("dependencies") if "dependencies" in contexts.columns else None
    simple = contexts.where(F.col("eligible") & is_simple(deps))
    note = F.format_string(
        "Optimization opportunity: %s (%s) at lines %d-%d", "type", "name", "start_line", "end_line"
    )
    return simple.join(kept, F.col("file") == F.col("_pfile"), "left_semi").select(
        "file", "type", "name", "complexity", note.alias("note")
    )


def _compared_columns(baseline: DataFrame, keys: Sequence[str], columns: Sequence[str] | None) -> list[str]:
    return [c for c in (columns if columns is not None else baseline.columns) if c not in keys]


def _counted_rows(baseline: DataFrame, candidate: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """How often each row occurs in the baseline (``_b``) and in the candidate (``_c``)."""

    def comparable(df: DataFrame) -> list[Column]:
        is_map = {c: isinstance(df.schema[c].dataType, T_.MapType) for c in values}
        return [F.array_sort(F.map_entries(c)).alias(c) if is_map[c] else F.col(c) for c in values]

    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = baseline.select(*keys, *comparable(baseline), one.alias("_b"), none.alias("_c")).unionByName(
        candidate.select(*keys, *comparable(candidate), none.alias("_b"), one.alias("_c"))
    )
    return both.groupBy(*keys, *values).agg(F.sum("_b").alias("_b"), F.sum("_c").alias("_c"))


def compare_datasets(
    baseline: DataFrame, candidate: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Rows matched, changed, missing and extra per key, with NULL equal to NULL.

    Both sides are counted per (key, values) rather than joined: copies of a row
    collapse map-side, repeated keys form no pairs, and each side is shuffled once.
    The second aggregation carries only keys and counts. A MAP is compared as its sorted entries.
    """
    keys = list(keys)
    values = _compared_columns(baseline, keys, columns)
    counted = _counted_rows(baseline, candidate, keys, values)
    zero = F.lit(0).cast("bigint")
    per_key = counted.groupBy(*keys).agg(
        F.sum(F.least("_b", "_c")).alias("matched"),
        F.sum(F.greatest(F.col("_b") - F.col("_c"), zero)).alias("_only_b"),
        F.sum(F.greatest(F.col("_c") - F.col("_b"), zero)).alias("_only_c"),
    )
    changed = F.least("_only_b", "_only_c")
    return per_key.select(
        *keys,
        "matched",
        changed.alias("changed"),
        (F.col("_only_b") - changed).alias("missing"),
        (F.col("_only_c") - changed).alias("extra"),
        F.when((F.col("_only_b") == 0) & (F.col("_only_c") == 0), F.lit("matched"))
        .when(F.col("_only_c") == 0, F.lit("missing"))
        .when(F.col("_only_b") == 0, F.lit("extra"))
        .otherwise(F.lit("changed"))
        .alias("status"),
    )


def compare_columns(
    baseline: DataFrame, candidate: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Per key and column, in how many of the key's changed rows the column differs: keys, ``column``, ``differing``.

    Equal rows cancel first, as they are counted and not joined. What is left of a key on
    both sides are its changed rows; in each column their values are matched as multisets, NULL equal to NULL, and what
    finds no equal counts. So copies and repeated keys form no pairs, and only changed rows
    are taken apart into columns. Rows of keys on one side only are missing or extra rows and in no column.
    """
    keys = list(keys)
    values = _compared_columns(baseline, keys, columns)
    counted = _counted_rows(baseline, candidate, keys, values)
    zero = F.lit(0).cast("bigint")
    left = counted.where(F.col("_b") != F.col("_c")).withColumns(
        {"_b": F.greatest(F.col("_b") - F.col("_c"), zero), "_c": F.greatest(F.col("_c") - F.col("_b"), zero)}
    )

    def text(c: str) -> Column:
        kind = counted.schema[c].dataType
        value = F.col(c) + F.lit(0.0).cast(kind) if isinstance(kind, (T_.DoubleType, T_.FloatType)) else F.col(c)  # one zero
        return F.to_json(F.struct(value.alias("v")))

    cells = F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("value")) for c in values])
    apart = left.select(*keys, "_b", "_c", F.explode(cells).alias("_cell"))
    per_value = apart.groupBy(*keys, F.col("_cell.column").alias("column"), F.col("_cell.value").alias("_value")).agg(
        F.sum("_b").alias("_b"), F.sum("_c").alias("_c")
    )
    per_column = per_value.groupBy(*keys, "column").agg(
        F.sum(F.least("_b", "_c")).alias("_same"), F.least(F.sum("_b"), F.sum("_c")).alias("_changed")
    )
    differing = F.col("_changed") - F.least("_same", "_changed")
    return per_column.select(*keys, "column", differing.alias("differing")).where("differing > 0")


def changed_columns(compared: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Of ``compare_columns``: per key a ``mask`` with bit i for the i-th of ``columns`` that differs, and their names."""
    bit = F.lit(0).cast("bigint")
    for i, c in enumerate(columns):
        bit = F.when(F.col("column") == c, F.lit(1 << i).cast("bigint")).otherwise(bit)
    masks = compared.groupBy(*keys).agg(F.bit_or(bit).alias("mask"))
    names = [F.when(F.col("mask").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, F.lit(c)) for i, c in enumerate(columns)]
    return masks.withColumn("changed_columns", F.concat_ws(",", *names))


def column_summary(compared: DataFrame) -> DataFrame:
    """Of ``compare_columns``: per column that differs, its keys and rows."""
    return compared.groupBy("column").agg(F.count(F.lit(1)).alias("keys"), F.sum("differing").alias("rows"))


def passed_and_failed(compared: DataFrame) -> DataFrame:
    """The keys of ``compare_datasets`` with ``outcome``: passed, failed, or extra, which counts for neither."""
    outcome = F.when(F.col("status") == "matched", "passed").when(F.col("status") == "extra", "extra").otherwise("failed")
    return compared.withColumn("outcome", outcome)


def comparison_summary(compared: DataFrame) -> DataFrame:
    """Totals over a comparison and the share of baseline rows that match."""
    sums = compared.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("matched", "changed", "missing", "extra")]
    )
    total = F.col("matched") + F.col("changed") + F.col("missing")
    return sums.select(
        total.alias("total"),
        F.col("matched").alias("passed"),
        (F.col("changed") + F.col("missing")).alias("failed"),
        "extra",
        T.percent(F.col("matched"), total).alias("coverage"),
    )


def checksum_manifest(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """SHA-256 of each content, with the name of its sidecar file."""
    return files.select(
        path,
        F.sha2(F.col(content).cast("binary"), 256).alias("sha256"),
        F.concat(F.col(path).cast("string"), F.lit(".sha256")).alias("sidecar"),
    )


def duplicate_contents(manifest: DataFrame, path: str = "path") -> DataFrame:
    """Checksums that occur more than once, with the number of files and the first of them."""
    return (
        manifest.groupBy("sha256")
        .agg(F.count(F.lit(1)).alias("files"), F.min(path).alias("first_path"))
        .where(F.col("files") > 1)
    )


def size_report(files: DataFrame, by: Sequence[str], length: str = "length") -> DataFrame:
    """Total bytes per group, also as ``1.5KB`` or ``2.0MB``."""
    return (
        files.groupBy(*by)
        .agg(F.coalesce(F.sum(length), F.lit(0)).cast("bigint").alias("bytes"))
        .withColumn("size", T.human_size(F.col("bytes")))
    )


def parse_version(version: Column) -> Column:
    """Numbers of a version as an array, NULL when any part is no number.

    The text is cut at the first ``-`` and loses one leading ``v``.
    """
    core = F.regexp_replace(F.substring_index(version, "-", 1), "^v", "")
    parts = F.split(core, r"\.")
    numbers = F.transform(parts, lambda p: F.when(p.rlike(r"^[+]?[0-9]+\z"), p.try_cast("bigint")))
    return F.when((version != "") & F.forall(numbers, lambda n: n.isNotNull()), numbers)


def compare_versions(left: Column, right: Column) -> Column:
    """-1, 0 or 1 over the common length of two number arrays."""
    n = F.least(F.size(left), F.size(right))
    a, b = F.slice(left, F.lit(1), n), F.slice(right, F.lit(1), n)
    return F.when(a < b, F.lit(-1)).when(a > b, F.lit(1)).otherwise(F.lit(0))


def latest_versions(df: DataFrame, package: str, version: str) -> DataFrame:
    """Compare each version with the highest valid one of its package.

    Adds ``latest`` (numbers joined by dots), ``status`` (``ok``, ``invalid`` or
    ``mismatch`` when the numbers of parts differ), ``cmp`` and ``is_latest``.
    """
    parsed = df.withColumn("_parts", parse_version(F.col(version)))
    best = (
        parsed.where(F.col("_parts").isNotNull())
        .groupBy(F.col(package).alias("_package"))
        .agg(F.max("_parts").alias("_best"))
    )
    joined = parsed.join(best, F.col(package) == F.col("_package"), "left")
    status = (
        F.when(F.col("_parts").isNull(), F.lit("invalid"))
        .when(F.size("_parts") != F.size("_best"), F.lit("mismatch"))
        .otherwise(F.lit("ok"))
    )
    return (
        joined.withColumn("latest", F.array_join(F.col("_best").cast("array<string>"), "."))
        .withColumn("status", status)
        .withColumn("cmp", F.when(F.col("status") == "ok", compare_versions(F.col("_parts"), F.col("_best"))))
        .withColumn("is_latest", F.col("cmp") == 0)
        .drop("_parts", "_best", "_package")
    )
