import pytest
from pyspark.sql import functions as F

from flagframe.plans.passes import resolve_passes, run_passes, standard_passes


def registry():
    def step(name):
        return lambda df: df.withColumn("log", F.concat("log", F.lit(name)))

    return {n: step(n[0]) for n in ("bool-to-flags", "if-to-bitwise", "jump-table")}


def test_names_aliases_order_and_blanks(spark):
    df = spark.range(1).withColumn("log", F.lit(""))
    out = run_passes(df, " jumptable , bool2flags,if-to-bitwise ", registry())
    assert out.applied == ("jump-table", "bool-to-flags", "if-to-bitwise")
    assert out.df.first().log == "jbi" and out.skipped == ()
    assert resolve_passes("revolution", registry())[0] == ["bool-to-flags", "if-to-bitwise", "jump-table"]
    assert resolve_passes("", registry()) == ([], [])


def test_unknown_names(spark):
    df = spark.range(1).withColumn("log", F.lit(""))
    with pytest.warns(UserWarning, match="nope"):
        out = run_passes(df, ["nope", "jump-table"], registry())
    assert out.skipped == ("nope",) and out.df.first().log == "j"
    with pytest.raises(ValueError, match="nope"):
        run_passes(df, ["nope"], registry(), strict=True)


def test_failing_pass_ends_the_run(spark):
    def fail(_df):
        raise RuntimeError("broken pass")

    with pytest.raises(RuntimeError, match="broken pass"):
        run_passes(spark.range(1), "bad", {"bad": fail})


def test_standard_passes(spark):
    df = spark.createDataFrame([(1, True, False, "hello"), (2, False, True, "main"), (3, False, False, "x")], "k int, a boolean, b boolean, s string")
    updates = spark.createDataFrame([(1, 2)], "k int, set_mask int")
    passes = standard_passes(
        {"a": F.col("a"), "b": F.col("b")},
        condition={"any_of": ["a", "b"]},
        updates=(updates, "k"),
        fields=["b"],
        text=["s"],
        rules=("k", {}),
    )
    out = run_passes(df, "revolution", passes)
    assert out.applied == tuple(passes)
    assert {(r.k, r.flags, r.b, r.s) for r in out.df.collect()} == {
        (1, 3, True, "string([]byte{104, 101, 108, 108, 111})"), (2, 2, True, "main"),
    }
