import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flagframe.operators import masking, textscan


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, s string")


def test_masked_forms(spark):
    cases = {
        "plain": "string([]byte{112, 108, 97, 105, 110})",
        "SomeValue": "string([]byte{83, 111, 109, 101, 86, 97, 108, 117, 101})",
        "é12": "string([]byte{195, 169, 49, 50})",
        "abcd": "string([]byte{97, 98, 99, 100})",
        "ok": "ok",
        "abc": "abc",
        "": "",
        None: None,
        **{w: w for w in ("main", "func", "package", "import", "var", "const", "if", "else", "for", "range")},
    }
    got = masking.mask_literals(texts(spark, cases), "s", out="m").collect()
    assert {r.s: r.m for r in got} == cases


def test_declared_type_name(spark):
    got = masking.mask_literals(texts(spark, ["custom"]), "s", "LogType").first().s
    assert got == "LogType([]byte{99, 117, 115, 116, 111, 109})"
    by_column = texts(spark, ["custom"]).withColumn("t", F.lit("pkg.Kind"))
    assert masking.mask_literals(by_column, "s", F.col("t")).first().s.startswith("pkg.Kind([]byte{")


def test_unmask_is_the_inverse(spark):
    values = ["", "a", "häuser über alles", "日本語テキスト", "😀 emoji", "line\nbreak\t\0end", "string([]byte{1, 2})", "main", None]
    df = masking.unmask_literals(masking.mask_literals(texts(spark, values), "s", out="m"), "m", out="back")
    assert all(r.s == r.back for r in df.collect())


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.text(max_size=40), min_size=30, max_size=60))
def test_mask_is_lossless_and_lists_the_bytes(spark, values):
    df = masking.mask_literals(texts(spark, values), "s", out="m")
    for r in masking.unmask_literals(df, "m", out="back").collect():
        assert r.back == r.s
        raw = r.s.encode()
        if len(raw) >= 4 and r.s not in ("main", "func", "package", "import", "const", "else", "range"):
            assert r.m == f"string([]byte{{{', '.join(map(str, raw))}}})"
        else:
            assert r.m == r.s


def test_literal_report_reasons(spark):
    rows = [
        ("f", "fmt", True, False, False),
        ("f", "json:x", False, True, False),
        ("f", "debug", False, False, True),
        ("f", "ok", False, False, False),
        ("f", "range", False, False, False),
        ("f", "hello", False, False, False),
        ("f", "hello", False, None, False),
        ("g", "hello", False, False, False),
    ]
    df = spark.createDataFrame(rows, "file string, literal string, imp boolean, tag boolean, con boolean")
    got = masking.literal_report(df, is_import=F.col("imp"), is_tag="tag", is_constant="con").collect()
    assert {(r.file, r.reason): r.literals for r in got} == {
        ("f", "import"): 1, ("f", "tag"): 1, ("f", "constant"): 1, ("f", "short"): 1,
        ("f", "stop_word"): 1, ("f", "masked"): 2, ("g", "masked"): 1,
    }


@pytest.mark.parametrize("level", [1, 2, 3])
def test_pseudonyms_are_one_to_one(spark, level):
    names = spark.range(0, 1_000_000, 1, 8).select(F.concat(F.lit("name"), F.col("id").cast("string")).alias("a"))
    out = masking.pseudonymise(names, ["a"], level, "secret")
    assert out.select("a").distinct().count() == 1_000_000
    few = names.limit(50)
    alone = masking.pseudonymise(few.withColumn("name", F.col("a")), ["a"], level, "secret").collect()
    among = {r.name: r.a for r in masking.pseudonymise(names.withColumn("name", F.col("a")), ["a"], level, "secret").where(F.col("name").isin([r.name for r in alone])).collect()}
    assert {r.name: r.a for r in alone} == among
    other = masking.pseudonymise(few, ["a"], level, "other").collect()
    assert not {r.a for r in other} & {r.a for r in alone}


def test_pseudonym_shapes(spark):
    row = texts(spark, ["Config"]).select(
        *[masking.pseudonym(F.col("s"), n, "k").alias(f"l{n}") for n in (1, 2, 3, 4)]
    ).first()
    assert row.l1[0] == "c" and len(row.l1) == 5
    assert len(row.l2) == 9 and row.l2[6] == "_"
    assert row.l3[:2] in masking.PREFIXES and row.l3[5:] in masking.SUFFIXES and row.l3[4] == "_"
    assert row.l4 == "Config"
    df = texts(spark, ["Config", None])
    assert [r.s is None for r in masking.pseudonymise(df, ["s"], 2, "k").orderBy("id").collect()] == [False, True]


def test_policy_last_mark_wins(spark):
    df = texts(spark, ["first text", "second text", "third text"])
    marks = spark.createDataFrame(
        [(0, 1, "nobfuscate"), (0, 2, "force"), (1, 1, "force"), (1, 5, "nobfuscate"), (9, 1, "nobfuscate")],
        "id int, seq int, mark string",
    )
    out = masking.mask_by_policy(df, marks, "id", "s")
    assert {r.id: r.policy for r in out.collect()} == {0: "masked", 1: "skipped", 2: "masked"}
    assert {r.id: r.s for r in out.collect()}[1] == "second text"
    assert tuple(masking.policy_counts(out).first()) == (2, 1)


def test_control_marks(spark):
    df = texts(spark, ["// tool:nobfuscate", "tool:force and tool:nobfuscate", "//tool:force", "none"])
    got = [r.m for r in df.select(masking.control_mark(F.col("s"), "tool").alias("m")).collect()]
    assert got == ["nobfuscate", "nobfuscate", "force", None]


def test_first_keyword_decides(spark):
    df = texts(spark, ["checkLogin", "LOGINForm", "userAuthCheck", "none", None])
    assert [r.keyword for r in textscan.tag_keywords(df, "s").collect()] == ["login", "login", "auth", None, None]
    counts = {r.keyword: (r.rows_with, r.rows_first) for r in textscan.keyword_counts(df, "s").collect()}
    assert counts["check"] == (2, 0) and counts["login"] == (2, 2) and counts["permission"] == (0, 0)


def test_token_classes_with_accents(spark):
    df = texts(spark, ["ÉTÉ été Été _x $y 9a A_1 mañana"])
    got = {r["class"]: r.tokens for r in textscan.token_profile(df, ["id"], "s").collect()}
    assert got == {"all_caps": 2, "all_lower": 5, "constant_like": 8, "identifier": 5, "valid_ident": 4}


def test_rebase_paths(spark):
    paths = ["fmt", "net/http", "internal/x", "host.org/a/b", "site/own", "a//b/"]
    expected = ["fmt", "net/http", "site/internal/x", "host.org/a/b", "site/own", "site/a/b"]
    df = texts(spark, paths)
    assert [r.s for r in textscan.rebase_paths(df, "s", "site", ["fmt", "net"]).orderBy("id").collect()] == expected
    assert [r.s for r in textscan.rebase_paths(df, "s", "site").orderBy("id").collect()] == expected
    roots = spark.createDataFrame([("fmt",), ("net",)], "root string")
    assert [r.s for r in textscan.rebase_paths(df, "s", "site", roots).orderBy("id").collect()] == expected


def test_first_line_with_prefix(spark):
    df = texts(spark, ["// c\n  module  example/x \nmodule y", "nothing", "modulex\nmodule\n", None, "\tmodule a\r\n"])
    got = [r.line for r in textscan.first_line_with_prefix(df, "s", "module ").collect()]
    assert got == ["example/x", None, None, None, "a"]


def test_count_lines_matching(spark):
    df = texts(spark, ["--- PASS: a\nok  pkg PASS: b\nFAIL\nok", "", None])
    assert [r.lines for r in textscan.count_lines_matching(df, "s", ["PASS:", "ok "]).collect()] == [2, 0, 0]


def test_odd_byte_lists_stay(spark):
    odd = ["foo([]byte{99999999999})", "foo([]byte{256, 1})", "foo([]byte{255, 254})", "foo([]byte{195})", "x"]
    df = texts(spark, [*odd, "foo([]byte{195, 169})"])
    assert [r.s for r in masking.unmask_literals(df, "s").orderBy("id").collect()] == [*odd, "é"]
