import json

import pytest
from pyspark.sql import functions as F

from flagframe.operators import reports
from flagframe.operators.flags import flag_dictionary
from flagframe.sources import dictionary, files, outputs, registry


@pytest.fixture
def tree(tmp_path):
    for name, body in {
        "main.go": "package main", "main_test.go": "package main", "sub/a.go": "package sub", "sub/b.txt": "text", "sub/bad.go": "broken",
    }.items():
        path = tmp_path / "src" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    return str(tmp_path / "src")


def names(df):
    return {r.path.rsplit("/src/", 1)[1] for r in df.collect()}


def test_scan_policies(spark, tree):
    assert names(files.scan_policy(spark, tree, "engine")) == {"main.go", "sub/a.go", "sub/bad.go"}
    assert names(files.scan_policy(spark, tree, "package")) == {"main.go", "main_test.go"}
    assert names(files.scan_policy(spark, tree, "project")) == {"main.go", "main_test.go", "sub/a.go", "sub/bad.go"}
    listing = files.scan_files(spark, tree, ".txt", content=False)
    assert listing.columns == ["path", "length", "modificationTime"] and listing.first().length == 4


def test_check_files(spark, tree):
    def parse(content):
        if not content.startswith(b"package "):
            raise SyntaxError("no package clause")

    scanned = files.scan_policy(spark, tree, "project")
    checked = files.check_files(scanned, parse)
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in checked.where("status = 'error'").collect()}
    assert errors == {"bad.go": "SyntaxError: no package clause"}
    summary = {r.package.rsplit("/", 1)[1]: (r.checked, r.failed, r.status) for r in files.check_summary(checked).collect()}
    assert summary == {"src": (2, 0, "ok"), "sub": (2, 1, "failed")}
    assert files.check_files(scanned, parse, "warn").where("status = 'warning'").count() == 1
    with pytest.raises(Exception, match="no package clause"):
        files.check_files(scanned, parse, "failfast").collect()
    with pytest.raises(ValueError):
        files.check_files(scanned, parse, "other")


def test_check_rows(spark):
    rows = [(1, '{"k": 1}'), (2, '{"k": '), (3, ""), (4, None), (5, '{"k": "x"}')]
    df = spark.createDataFrame(rows, "id int, j string")
    got = {r.id: r.status for r in files.check_rows(df, "j", "k bigint", ["id"]).collect()}
    assert got == {1: "ok", 2: "error", 3: "error", 4: "ok", 5: "error"}
    warned = files.check_rows(df, "j", "k bigint", ["id"], "warn")
    assert warned.where("status = 'warning'").count() == 3
    with pytest.raises(Exception, match="malformed row"):
        files.check_rows(df, "j", "k bigint", ["id"], "failfast").collect()
    good = df.where("id = 1")
    assert files.check_rows(good, "j", "k bigint", ["id"], "failfast").first().status == "ok"
    all_bad = files.check_rows(df.where("id in (2, 3)"), "j", "k bigint", ["id"]).withColumn("package", F.lit("p"))
    assert tuple(files.check_summary(all_bad).first()) == ("p", 2, 2, "failed")


def test_dictionary_round_trip(spark, tmp_path):
    fields = spark.createDataFrame(
        [("f", "Config", i, n, "bool", 1) for i, n in enumerate(["Debug", "Verbose", "Logging"])],
        "file string, struct_name string, pos int, field string, type string, line int",
    )
    d = flag_dictionary(fields)
    dictionary.save_dictionary(d, str(tmp_path / "dict"))
    loaded = dictionary.load_dictionary(spark, str(tmp_path / "dict"))
    assert sorted(map(tuple, loaded.collect())) == sorted(map(tuple, d.collect()))
    known = dictionary.flag_set(loaded, "Config", "f")
    assert known.names == ("Debug", "Verbose", "Logging")
    assert dictionary.flag_set(loaded, "Config", name="flag_name").names[0] == "FlagConfig_Debug"
    with pytest.raises(ValueError, match="consecutive"):
        dictionary.flag_set(loaded.unionByName(loaded.withColumn("file", F.lit("g"))), "Config")
    log = spark.createDataFrame([("f", "Debug", "FlagConfig_Debug", True)], "file string, field string, flag_name string, value boolean")
    dictionary.save_assign_log(log, str(tmp_path / "log"))
    dictionary.save_assign_log(log, str(tmp_path / "log"))
    assert dictionary.load_assign_log(spark, str(tmp_path / "log")).count() == 2


def test_reports(spark, tmp_path):
    candidates = spark.createDataFrame([("b.x", "C", 2, 1), ("a.x", "Config", 6, 5)], "file string, struct_name string, bool_fields bigint, line int")
    found = reports.findings(candidates)
    summary = reports.summarise(found)
    assert outputs.write_report(found, summary, "json", str(tmp_path / "json"))
    rows = spark.read.json(str(tmp_path / "json/results")).orderBy("original_file").collect()
    assert [(r.original_file, r.optimization.bytes_saved, r.security_feature.strength) for r in rows] == [("a.x", 42, "Medium"), ("b.x", 14, "Medium")]
    assert spark.read.json(str(tmp_path / "json/summary")).first().total_optimizations == 2
    assert outputs.write_report(found, summary, "text", str(tmp_path / "text"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "text/results")).collect())
    assert "Speedup: 2.50x" in text and "Location: a.x:5" in text
    assert "Total optimizations: 2" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "text/summary")).collect())
    assert not outputs.write_report(found.limit(0), summary, "json", str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    with pytest.raises(ValueError):
        outputs.write_report(found, summary, "xml", str(tmp_path / "x"))
    with pytest.raises(NotImplementedError):
        outputs.write_report(found, summary, "yaml", str(tmp_path / "x"))


def test_report_as_one_document(spark, tmp_path):
    rows = [("b.go", "C", 2, 1), ('a"x\\.go', "Config", 6, 5), ("b.go", "D", 4, 40), ("b.go", "E", 1, 7)] + [("hot.go", f"S{i}", 1 + i % 5, i) for i in range(400)]
    candidates = spark.createDataFrame(rows, "file string, struct_name string, bool_fields bigint, line int")
    found = reports.findings(candidates)
    assert outputs.write_document(found, reports.summarise(found), str(tmp_path / "doc"))
    parts = sorted((tmp_path / "doc").glob("part-*"))
    document = json.loads("".join(p.read_text() for p in parts))
    assert document["summary"]["total_optimizations"] == len(rows)
    by_file = {r["original_file"]: r for r in document["results"]}
    assert list(by_file) == sorted({r[0] for r in rows}) and len(by_file) == len(document["results"])
    for file, one in by_file.items():
        mine = [r for r in rows if r[0] == file]
        assert one["findings"] == len(one["optimizations"]) == len(one["security_features"]) == len(mine)
        assert sorted(o["bytes_saved"] for o in one["optimizations"]) == sorted(7 * r[2] for r in mine)
        assert one["transpiled_file"] == file.replace(".go", "_bitwise.go")
    assert not outputs.write_document(found.limit(0), reports.summarise(found.limit(0)), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_converted_names(spark):
    df = spark.createDataFrame([("a/b.go",), ("x.golden/y.go",), ("none.txt",)], "p string")
    got = [r.n for r in df.select(outputs.converted_name(F.col("p")).alias("n")).collect()]
    assert got == ["a/b_bitwise.go", "x_bitwise.golden/y.go", "none.txt"]


def test_overlay_and_manifest_sinks(spark, tmp_path):
    original = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content string")
    merged = reports.overlay(original, original.where("path = 'a'").withColumn("content", F.lit("n")), "path", "content")
    outputs.write_overlay(merged, str(tmp_path / "out"))
    assert (tmp_path / "out/origin=generated").exists()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    outputs.write_manifest(reports.checksum_manifest(original), str(tmp_path / "sums"))
    assert all(r.value[64:66] == "  " for r in spark.read.text(str(tmp_path / "sums")).collect())


CONTROL = {
    "schema_version": 3,
    "ipc": {"type": "pipe", "socket": "/tmp/gate-7", "mode": "0644"},
    "bitreg": {"brf_path": "/var/bits", "ns_bits": 96, "policy": "own", "cap_mask": "0x00000000000000f0", "state_hex": "0x0000000000000005"},
    "kv": {
        "declare_hashes": [{"key_hash": "0x51"}],
        "values": [{"key_hash": "0x51", "u64_hex": "0x1f4"}, {"key_hash": "0x77"}],
        "encoding": "plain",
    },
    "seq": 4,
    "epoch_ns": 1700000000123456999,
}


def test_registry_nested_and_flat(spark, tmp_path):
    for name, body in {"control_one.json": {"control": CONTROL}, "control_two.json": CONTROL, "bad.json": {}}.items():
        (tmp_path / name).write_text(json.dumps(body, indent=2))
    entries = registry.read_registry(spark, str(tmp_path))
    decoded = {r.module: r for r in registry.decode_registry(entries, "body", ["module"]).collect()}
    assert set(decoded) == {"one", "two", "bad"}
    for module in ("one", "two"):
        r = decoded[module]
        assert (r.state, r.cap_mask, r.ns_bits, r.ipc_mode, r.declared, r.seq) == (5, 240, 96, "0644", 1, 4)
        assert str(r.epoch) == "2023-11-14 22:13:20.123456"
    assert decoded["bad"].state is None
    values = registry.registry_values(entries, "body", ["module"]).where("module = 'one'").collect()
    assert {(r.key_hash, r.value, r.declared) for r in values} == {(0x51, 500, True), (0x77, None, False)}
