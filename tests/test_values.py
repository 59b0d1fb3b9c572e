"""Values that the test tables do not hit: rounding, blanks, empty paths."""

from pyspark.sql import functions as F

from flagframe.functions import text as T
from flagframe.operators import textscan


def test_one_decimal_rounds_the_exact_value(spark):
    values = [p / w * 100 for w in range(20, 2001, 140) for p in range(w + 1)] + [0.05, 0.15, 0.25, 0.35, 0.75, 12.35, 1.0, 99.95, 1e12 + 0.25, 1e17, -0.25, -12.35, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    wrong = [(r.v, r.s) for r in df.select("v", T.one_decimal(F.col("v")).alias("s")).collect() if r.s != f"{r.v:.1f}"]
    assert not wrong, wrong[:5]
    assert spark.range(1).select(T.percent(F.lit(1), F.lit(2000)).alias("p")).first().p == "0.1%"


def test_unicode_blanks_are_trimmed(spark):
    blanks = "　      "
    df = spark.createDataFrame([(f"x\n{blanks}module  a b{blanks}\nmodule c",)], "t string")
    assert textscan.first_line_with_prefix(df, "t", "module ").first().line == "a b"


def test_empty_paths_become_the_root(spark):
    df = spark.createDataFrame([("",), ("/",), ("a//b/",), ("fmt/x",)], "p string")
    assert [r.p for r in textscan.rebase_paths(df, "p", "site").collect()] == ["site", "site", "site/a/b", "fmt/x"]
