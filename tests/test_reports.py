import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flagframe.functions import text as T
from flagframe.operators import reports

CANDIDATE = "file string, struct_name string, bool_fields bigint, line int"


def test_finding_and_summary(spark):
    found = reports.findings(spark.createDataFrame([("main.x", "Config", 6, 5), ("main.x", "B", 1, 9), ("b.x", "C", 2, 1)], CANDIDATE))
    row = found.where("description like '%Config'").first()
    assert (row.type, row.location, row.bytes_saved, row.speedup) == ("BitfieldConversion", "main.x:5", 42, 2.5)
    assert row.description == "Convert 6 bool fields to bitwise flags in struct Config"
    assert row.security_strength == "Medium"
    assert tuple(reports.summarise(found).first()) == (2, 3, 63, 2.5, 3)
    assert tuple(reports.summarise(found.limit(0)).first()) == (0, 0, 0, 1.0, 0)


def test_project_stats(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    contexts = spark.createDataFrame([("a",), ("a",), ("b",)], "file string")
    outcome = spark.createDataFrame(
        [("a", True, None), ("b", False, "boom"), ("c", True, None)], "file string, transformed boolean, error string"
    )
    got = reports.project_stats(files, contexts, outcome).first().asDict()
    assert got == {
        "total_files": 3, "files_with_contexts": 2, "transpiled_files": 1, "contexts_found": 3, "contexts_transpiled": 2, "errors": 1,
    }
    assert [tuple(r) for r in reports.project_issues(outcome).collect()] == [("b", "boom")]


def test_size_estimate(spark):
    dictionary = spark.createDataFrame([("S", f"f{i}") for i in range(16)] + [("T", "x")], "struct_name string, field string")
    counts = spark.createDataFrame([("S", 10), ("T", 10), ("U", 1)], "struct_name string, rows bigint")
    got = {r.struct_name: tuple(r)[1:] for r in reports.size_estimate(dictionary, counts).collect()}
    assert got == {"S": (16, 10, 160, 80, 50.0), "T": (1, 10, 10, 80, 0.0), "U": (0, 1, 0, 8, None)}


def test_overlay(spark):
    original = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "path string, content string")
    generated = spark.createDataFrame([("a", "new"), ("b", None), ("z", "only")], "path string, content string")
    got = {r.path: (r.content, r.origin) for r in reports.overlay(original, generated, "path", "content").collect()}
    assert got == {"a": ("new", "generated"), "b": ("2", "original"), "c": (None, "original")}


def test_routes(spark):
    paths = ["main.go", "x/cmd/main.go", "a/server_main.go", "a/b.go", "domain.go", "a/main.go.txt", "none.go"]
    files = spark.createDataFrame([(p,) for p in paths], "file string")
    rows = [(p, "function", "check", 1, 3, 9, True) for p in paths[:-1]] + [("main.go", "function", "big", 9, 1, 2, False)]
    contexts = spark.createDataFrame(
        rows, "file string, type string, name string, complexity int, start_line int, end_line int, eligible boolean"
    )
    routed = reports.route_files(files, contexts)
    assert {r.file: r.route for r in routed.collect()} == {
        "main.go": "preserve", "x/cmd/main.go": "preserve", "a/server_main.go": "preserve", "a/b.go": "transform",
        "domain.go": "transform", "a/main.go.txt": "transform", "none.go": "copy",
    }
    notes = reports.preserved_annotations(routed, contexts).collect()
    assert {r.file for r in notes} == {"main.go", "x/cmd/main.go", "a/server_main.go"} and len(notes) == 3
    assert notes[0].note == "Optimization opportunity: function (check) at lines 3-9"


def compared(spark, left, right, keys=("k",)):
    schema = "k int, v double, s string"
    return reports.compare_datasets(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), keys)


def test_compare_statuses(spark):
    left = [(1, 1.0, "a"), (2, None, None), (3, 1.0, "a"), (4, 1.0, None), (None, 1.0, "n")]
    right = [(1, 1.0, "a"), (2, None, None), (3, 2.0, "a"), (5, 1.0, "x"), (None, 1.0, "n")]
    out = compared(spark, left, right)
    assert {r.k: r.status for r in out.collect()} == {
        1: "matched", 2: "matched", 3: "changed", 4: "missing", 5: "extra", None: "matched",
    }
    assert tuple(reports.comparison_summary(out).first()) == (5, 3, 2, 1, "60.0%")


def test_compare_with_itself_and_empty(spark):
    rows = [(i % 5, float(i), "x") for i in range(50)]
    out = compared(spark, rows, rows)
    assert {r.status for r in out.collect()} == {"matched"}
    assert tuple(reports.comparison_summary(out).first()) == (50, 50, 0, 0, "100.0%")
    assert tuple(reports.comparison_summary(compared(spark, [], [])).first()) == (0, 0, 0, 0, "0.0%")


def test_compare_copies_as_multisets(spark):
    rng = random.Random(8)
    left = [(rng.randrange(4), float(rng.randrange(3)), "x") for _ in range(200)]
    right = [(rng.randrange(4), float(rng.randrange(3)), "x") for _ in range(150)]
    got = {r.k: (r.matched, r.changed, r.missing, r.extra) for r in compared(spark, left, right).collect()}
    for k in range(4):
        a = [r for r in left if r[0] == k]
        b = [r for r in right if r[0] == k]
        same = sum(min(a.count(x), b.count(x)) for x in set(a))
        only_a, only_b = len(a) - same, len(b) - same
        both = min(only_a, only_b)
        assert got[k] == (same, both, only_a - both, only_b - both)


def test_checksums(spark):
    files = spark.createDataFrame([("a", b"x"), ("b", b"x"), ("c", b"\x00\xff")], "path string, content binary")
    manifest = reports.checksum_manifest(files)
    got = {r.path: (r.sha256, r.sidecar) for r in manifest.collect()}
    assert got["c"] == (hashlib.sha256(b"\x00\xff").hexdigest(), "c.sha256")
    assert [tuple(r) for r in reports.duplicate_contents(manifest).collect()] == [(hashlib.sha256(b"x").hexdigest(), 2, "a")]


def test_size_report(spark):
    sizes = [0, 512, 1024 * 1024, 1024 * 1024 + 1, 3 * 1024 * 1024, 256, 768, 12345678]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "g int, length bigint")
    got = {r.g: r["size"] for r in reports.size_report(df, ["g"]).collect()}

    def size(n):
        return f"{n / 1024 / 1024:.1f}MB" if n > 1024 * 1024 else f"{n / 1024:.1f}KB"

    assert got == {i: size(n) for i, n in enumerate(sizes)}


def test_percent_rounds_ties_to_even(spark):
    df = spark.createDataFrame([(1, 16), (3, 16), (1, 3), (0, 0), (2, 3)], "a bigint, b bigint")
    got = [r.p for r in df.select(T.percent(F.col("a"), F.col("b")).alias("p")).collect()]
    assert got == ["6.2%", "18.8%", "33.3%", "0.0%", "66.7%"]


@pytest.mark.parametrize(
    "text,parts",
    [
        ("v1.2.3", [1, 2, 3]),
        ("1.2.3-rc1", [1, 2, 3]),
        ("1.x", None),
        ("", None),
        (None, None),
        ("vv1", None),
        ("1..2", None),
        ("-1.2", None),
        (" 1.2", None),
        ("+1.2", [1, 2]),
        ("1.99999999999999999999", None),
        ("10.0", [10, 0]),
    ],
)
def test_parse_version(spark, text, parts):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(reports.parse_version(F.col("v")).alias("p")).first().p == parts


def test_latest_versions(spark):
    rows = [("a", "1.9.9"), ("a", "v1.10.0"), ("a", "1.10.0-rc1"), ("a", "1.x"), ("a", "1.2"), ("b", "bad")]
    df = spark.createDataFrame(rows, "pkg string, version string")
    got = {(r.pkg, r.version): (r.latest, r.status, r["cmp"], r.is_latest) for r in reports.latest_versions(df, "pkg", "version").collect()}
    assert got == {
        ("a", "1.9.9"): ("1.10.0", "ok", -1, False),
        ("a", "v1.10.0"): ("1.10.0", "ok", 0, True),
        ("a", "1.10.0-rc1"): ("1.10.0", "ok", 0, True),
        ("a", "1.x"): ("1.10.0", "invalid", None, None),
        ("a", "1.2"): ("1.10.0", "mismatch", None, None),
        ("b", "bad"): (None, "invalid", None, None),
    }


def _differing(baseline, candidate, names):
    """Changed rows per (key, column) by cancelling equal rows and then equal values."""
    out = {}
    for key in {r[0] for r in baseline + candidate}:
        b, c = ([repr(r[1:]) for r in side if r[0] == key] for side in (baseline, candidate))
        rest_b, rest_c = Counter(b) - Counter(c), Counter(c) - Counter(b)
        changed = min(rest_b.total(), rest_c.total())
        for i, name in enumerate(names):
            values = [Counter(), Counter()]
            for side, rest in enumerate((rest_b, rest_c)):
                for row, n in rest.items():
                    values[side][repr(eval(row)[i])] += n  # noqa: S307
            same = (values[0] & values[1]).total()
            if changed > same:
                out[key, name] = changed - same
    return out


def test_columns_that_differ(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(40), rng.choice(["x", "y", None]), rng.randrange(3), rng.choice([{"a": 1, "b": 2}, {"a": 1}, None])) for _ in range(200)]
    other = [(k, a if rng.random() < 0.8 else "z", n if rng.random() < 0.9 else None, m) for k, a, n, m in rows if rng.random() < 0.95]
    other += [(100, "x", 1, None), (0, "x", 0, {"b": 2, "a": 1})]
    schema = "k int, a string, n int, m map<string,int>"
    left, right = spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)
    found = reports.compare_columns(left, right, ["k"])
    got = {(r.k, r.column): r.differing for r in found.collect()}
    sort = [[(k, a, n, m and sorted(m.items())) for k, a, n, m in side] for side in (rows, other)]
    assert got == _differing(*sort, ["a", "n", "m"]) and got
    masks = {r.k: (r["mask"], r.changed_columns) for r in reports.changed_columns(found, ["k"], ["a", "n", "m"]).collect()}
    for key, (mask, names) in masks.items():
        own = [c for c in ("a", "n", "m") if (key, c) in got]
        assert names == ",".join(own) and mask == sum(1 << "anm".index(c) for c in own)
    totals = {r.column: (r["keys"], r["rows"]) for r in reports.column_summary(found).collect()}
    assert totals == {c: (sum(1 for k, x in got if x == c), sum(v for (_, x), v in got.items() if x == c)) for c in {x for _, x in got}}
    assert reports.compare_columns(left, left, ["k"]).count() == 0


def test_maps_compare_by_entries(spark):
    schema = "k int, m map<string,int>, d double"
    left = spark.createDataFrame([(1, {"a": 1, "b": 2}, 0.0), (2, {"a": 1}, float("nan")), (3, None, None)], schema)
    right = spark.createDataFrame([(1, {"b": 2, "a": 1}, -0.0), (2, {"a": 2}, float("nan")), (3, None, None)], schema)
    status = {r.k: r.status for r in reports.compare_datasets(left, right, ["k"]).collect()}
    assert status == {1: "matched", 2: "changed", 3: "matched"}
    assert [(r.k, r.column, r.differing) for r in reports.compare_columns(left, right, ["k"]).collect()] == [(2, "m", 1)]
    outcome = reports.passed_and_failed(reports.compare_datasets(left, right.where("k < 3"), ["k"])).collect()
    assert {r.k: r.outcome for r in outcome} == {1: "passed", 2: "failed", 3: "failed"}
