"""Sinks: analysis reports, overlays and checksum sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flagframe.operators.ordered import number_rows

FORMATS = ("json", "text")


def write_report(found: DataFrame, summary: DataFrame, fmt: str, path: str) -> bool:
    """Write ``<path>/summary`` and ``<path>/results``; False when there is nothing to write.

    Results are one JSON object, or one block of text lines, per finding, without a global
    order: a nested list per file would have to fit one row.
    """
    if fmt == "yaml":
        raise NotImplementedError("YAML output is not implemented")
    if fmt not in FORMATS:
        raise ValueError(f"invalid output format: {fmt}")
    if found.isEmpty():
        return False
    if fmt == "json":
        nested = found.select(
            F.col("file").alias("original_file"),
            converted_name(F.col("file")).alias("transpiled_file"),
            F.struct(
                "type", "description", "location", "bytes_saved", F.col("speedup").alias("speedup_factor")
            ).alias("optimization"),
            F.struct(
                F.col("security_description").alias("description"), F.col("security_strength").alias("strength")
            ).alias("security_feature"),
        )
        nested.write.mode("overwrite").json(f"{path}/results")
        summary.write.mode("overwrite").json(f"{path}/summary")
        return True
    found.select(_finding_lines()).write.mode("overwrite").text(f"{path}/results")
    summary.select(_summary_lines()).write.mode("overwrite").text(f"{path}/summary")
    return True


def document_lines(found: DataFrame, summary: DataFrame) -> DataFrame:
    """The report as the lines of one JSON document: ``part``, ``file``, ``section``, ``number``, ``value``.

    Read in the order of these columns the lines are ``{"summary": ..., "results": [...]}`` with an object per file
    that holds its findings and security features as lists. A finding is a line, and what opens, separates and closes lists
    follows from its number among the findings of its file, so no list is ever gathered into a row.
    """
    of_file = number_rows(found, ["file"], ["location", "description"], "number", "found_in_file")
    first = found.agg(F.min("file")).first()[0]
    text = F.to_json(F.struct(F.col("file").alias("f")))  # quotes and escapes as JSON wants them
    name = F.substr(text, F.lit(6), F.length(text) - 6)
    other = F.to_json(F.struct(converted_name(F.col("file")).alias("f")))
    converted = F.substr(other, F.lit(6), F.length(other) - 6)
    begin = F.when(F.col("file") == F.lit(first), "").otherwise(",")
    opening = F.concat(begin, F.lit('{"original_file":'), name, F.lit(',"transpiled_file":'), converted, F.lit(',"findings":'), F.col("found_in_file").cast("string"), F.lit(',"optimizations":['))
    item = F.to_json(F.struct("type", "description", "location", "bytes_saved", F.col("speedup").alias("speedup_factor")))
    feature = F.to_json(F.struct(F.col("security_description").alias("description"), F.col("security_strength").alias("strength")))
    is_first, is_last = F.col("number") == 1, F.col("number") == F.col("found_in_file")
    optimization = F.concat(F.when(is_first, opening).otherwise(","), item, F.when(is_last, '],"security_features":[').otherwise(""))
    security = F.concat(F.when(is_first, "").otherwise(","), feature, F.when(is_last, "]}").otherwise(""))
    sections = F.array(F.struct(F.lit(0).alias("section"), optimization.alias("value")), F.struct(F.lit(1).alias("section"), security.alias("value")))
    rows = of_file.select(F.lit(1).alias("part"), "file", "number", F.explode(sections).alias("s"))
    rows = rows.select("part", "file", "s.section", "number", "s.value")
    head = F.concat(F.lit('{"summary":'), F.to_json(F.struct(*summary.columns)), F.lit(',"results":['))
    edge = [F.lit(None).cast("string").alias("file"), F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("number")]
    ends = summary.select(F.explode(F.array(F.struct(F.lit(0).alias("part"), head.alias("value")), F.struct(F.lit(2).alias("part"), F.lit("]}").alias("value")))).alias("s"))
    return rows.unionByName(ends.select("s.part", *edge, "s.value"))


def write_document(found: DataFrame, summary: DataFrame, path: str) -> bool:
    """Write the report as one JSON document, cut into text parts; False when there is nothing to write.

    The parts' names sort as the document goes: joined in that order, they are valid JSON.
    """
    if found.isEmpty():
        return False
    order = ["part", "file", "section", "number"]
    lines = document_lines(found, summary).repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select("value").write.mode("overwrite").text(path)
    return True


def report_lines(found: DataFrame) -> DataFrame:
    """Text block of each finding, with its number among the findings of its file."""
    of_file = number_rows(found, ["file"], ["location", "description"], "number", "found_in_file")
    head = F.format_string("%d of %d in %s", "number", "found_in_file", "file")
    return of_file.select("file", F.col("number"), F.concat_ws("\n", head, _finding_lines()).alias("lines"))


def converted_name(path: Column) -> Column:
    """Name of the converted file: ``_bitwise`` before the first ``.go``."""
    at = F.locate(".go", path)
    renamed = F.concat(F.substring(path, F.lit(1), at - 1), F.lit("_bitwise"), F.substring(path, at, F.length(path)))
    return F.when(at > 0, renamed).otherwise(path)


def _finding_lines() -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("File: "), "file"),
        F.concat(F.lit("  "), "description"),
        F.concat(F.lit("     Type: "), "type"),
        F.concat(F.lit("     Location: "), "location"),
        F.concat(F.lit("     Bytes saved: "), F.col("bytes_saved").cast("string")),
        F.format_string("     Speedup: %.2fx", "speedup"),
        F.format_string("  Security: %s (%s)", "security_description", "security_strength"),
    ).alias("value")


def _summary_lines() -> Column:
    return F.concat_ws(
        "\n",
        F.lit("Bitwise Analysis Results"),
        F.concat(F.lit("  Files analyzed: "), F.col("files_analyzed").cast("string")),
        F.concat(F.lit("  Total optimizations: "), F.col("total_optimizations").cast("string")),
        F.concat(F.lit("  Estimated bytes saved: "), F.col("estimated_bytes_saved").cast("string")),
        F.format_string("  Average speedup factor: %.2fx", "average_speedup_factor"),
        F.concat(F.lit("  Security features: "), F.col("security_features").cast("string")),
    ).alias("value")


def write_overlay(overlaid: DataFrame, path: str) -> None:
    """Write an overlay, partitioned by where each row came from."""
    overlaid.write.mode("overwrite").partitionBy("origin").parquet(path)


def write_manifest(manifest: DataFrame, path: str, name: str = "path") -> None:
    """Checksum lines, ``<sha256>  <name>``."""
    manifest.select(F.concat_ws("  ", "sha256", F.col(name).cast("string")).alias("value")).write.mode(
        "overwrite"
    ).text(path)
