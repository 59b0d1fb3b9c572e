"""File skipping by masks (A3) and logs folded run by run (A5)."""

import random

import pytest
from pyspark.sql import functions as F

from flagframe.functions.bits import FlagSet
from flagframe.operators import flags
from flagframe.sources import folds, masked

SMALL = FlagSet(("a", "b", "c", "d"))
WIDE = FlagSet(tuple(f"f{i}" for i in range(70)))
ASKED = [dict(all_of=["a", "c"]), dict(any_of=["b", "d"]), dict(none_of=["d"]), dict(all_of=["d"], any_of=["a", "b"], none_of=["c"]), {}]


@pytest.mark.parametrize("asked", ASKED)
def test_only_files_that_can_match_are_opened(spark, tmp_path, asked):
    rows = [(i, None if i % 50 == 0 else i * 7 % 16) for i in range(800)]
    table = spark.createDataFrame(rows, "id long, flags smallint")
    path = str(tmp_path / "t")
    masked.write_masked(table, path, SMALL, files=8)
    got = masked.read_masked(spark, path, SMALL, **asked)
    assert sorted(got.collect()) == sorted(flags.filter_flags(table, SMALL, **asked).collect())
    everything = len(spark.read.parquet(path).inputFiles())
    assert everything > 2 and (len(got.inputFiles()) < everything) == bool(asked)


def test_wide_masks_files_added_later_and_nothing_that_matches(spark, tmp_path):
    rows = [(i, [1 << (i % 20), 1 << (i % 3)]) for i in range(300)]
    table = spark.createDataFrame(rows, "id long, flags array<bigint>")
    path = str(tmp_path / "t")
    masked.write_masked(table, path, WIDE, files=8)
    asked = dict(all_of=["f65"], none_of=["f4"])
    assert masked.read_masked(spark, path, WIDE, **asked).count() == flags.filter_flags(table, WIDE, **asked).count() > 0
    assert masked.read_masked(spark, path, WIDE, all_of=["f69"]).count() == 0
    spark.createDataFrame([(1000, [0, 1 << 5])], "id long, flags array<bigint>").write.mode("append").parquet(path)
    assert [r.id for r in masked.read_masked(spark, path, WIDE, all_of=["f69"]).collect()] == [1000]
    masked.summarise_masks(spark, path, WIDE)
    assert [r.id for r in masked.read_masked(spark, path, WIDE, all_of=["f69"]).collect()] == [1000]


def test_runs_in_any_order_and_repeated_equal_the_whole_log(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(9), rng.choice("abcdx"), rng.random() < 0.5, i) for i in range(400)]
    log = spark.createDataFrame(rows + [(3, "a", True, None)], "key long, field string, value boolean, seq long")
    whole = flags.fold_assignments(log, SMALL, "key")
    path = str(tmp_path / "state")
    for run in (3, 1, 0, 3, 2, 1):
        folds.save_fold(folds.fold_log(log.where(F.col("seq") % 4 == run), ["key"]), path, f"run-{run}")
        if run == 0:
            folds.compact_folds(spark, path, ["key"])
    assert sorted(folds.masks_of(folds.load_folds(spark, path, ["key"]), SMALL, ["key"]).collect()) == sorted(whole.collect())
    folds.compact_folds(spark, path, ["key"])
    assert sorted(folds.masks_of(folds.load_folds(spark, path, ["key"]), SMALL, ["key"]).collect()) == sorted(whole.collect())
    assert len(list((tmp_path / "state").glob("run_id=*"))) == 1
    with pytest.raises(ValueError):
        folds.save_fold(log, path, "../elsewhere")
