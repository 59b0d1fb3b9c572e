"""Tables with masks whose files are skipped by what their masks can hold.

No reader takes a predicate on a bit to its statistics. So a table is written with a small
table beside it: per file the OR and the AND of all its masks. A bit that no mask of a file has is missing in
the OR, a bit that all have is set in the AND; what they rule out is never opened.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flagframe.functions import bits
from flagframe.functions.bits import FlagSet
from flagframe.operators.flags import filter_flags

SUMMARY = "_mask_summary"  # readers of the table pass over names that begin with an underscore


def write_masked(df: DataFrame, path: str, flags: FlagSet, mask: str = "flags", sort: bool = True, files: int | None = None) -> None:
    """Write ``df`` as Parquet, replacing what is there, and the OR and AND of the masks of each file.

    With ``sort`` the rows are range-partitioned by mask and then by a hash of the row, so that a file holds few
    different masks and a mask that most rows have still fills several files. Their number follows from the
    data's size unless ``files`` gives it.
    """
    if sort:
        order = [F.col(mask), F.xxhash64(*[F.col(c) for c in df.columns])]
        df = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    df.write.mode("overwrite").parquet(path)
    summarise_masks(df.sparkSession, path, flags, mask)


def summarise_masks(spark: SparkSession, path: str, flags: FlagSet, mask: str = "flags") -> None:
    """(Re)write the table of file, ORs and ANDs per word; only the mask's column is read."""
    rows = spark.read.parquet(path)
    words = bits.words_of(F.col(mask), bits.n_words(flags)) if flags.is_wide else [F.col(mask).cast("bigint")]
    folds = [fold(word).alias(f"{name}{i}") for i, word in enumerate(words) for name, fold in (("any", F.bit_or), ("every", F.bit_and))]
    rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(*folds).write.mode("overwrite").parquet(f"{path}/{SUMMARY}")


def _possible(flags: FlagSet, all_of: Sequence[str], any_of: Sequence[str], none_of: Sequence[str]) -> Column:
    """Whether a file may hold a matching mask; a file of null masks holds none."""

    def wanted(names: Sequence[str]) -> list[tuple[int, Column]]:
        return [(w, F.lit(m).cast("bigint")) for w, m in (flags.words(names) if flags.is_wide else {0: flags.value(*names)}).items()]

    tests = [F.col(f"any{w}").bitwiseAND(m) == m for w, m in wanted(all_of)] if all_of else []
    if any_of:
        tests.append(reduce(lambda a, b: a | b, [F.col(f"any{w}").bitwiseAND(m) != 0 for w, m in wanted(any_of)]))
    if none_of:
        tests += [F.col(f"every{w}").bitwiseAND(m) == 0 for w, m in wanted(none_of)]
    return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))


def read_masked(
    spark: SparkSession,
    path: str,
    flags: FlagSet,
    mask: str = "flags",
    all_of: Iterable[str] = (),
    any_of: Iterable[str] = (),
    none_of: Iterable[str] = (),
) -> DataFrame:
    """The rows with all of, any of and none of the named flags, from the files that can hold one.

    A file is passed over only where the summary rules it out: files that were added later are read. The driver handles
    names of files, as it does for every scan. Rewritten files need ``summarise_masks`` anew.
    """
    all_of, any_of, none_of = list(all_of), list(any_of), list(none_of)
    table = spark.read.parquet(path)
    summary = spark.read.parquet(f"{path}/{SUMMARY}")
    ruled_out = {_name(r.file) for r in summary.where(~_possible(flags, all_of, any_of, none_of)).select("file").collect()}
    files = [f for f in table.inputFiles() if _name(f) not in ruled_out]
    if files:
        left = spark.read.schema(table.schema).option("basePath", path).parquet(*files) if ruled_out else table
    else:
        left = spark.createDataFrame([], T.StructType(table.schema.fields))
    return filter_flags(left, flags, mask, all_of=all_of, any_of=any_of, none_of=none_of)


def _name(file: str) -> str:
    """A file's path without scheme, which listings and metadata spell differently."""
    return file.split(":", 1)[-1].lstrip("/")
