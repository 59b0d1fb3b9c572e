import random

import pytest
from pyspark.sql import functions as F

from flagframe.functions import bits
from flagframe.functions.bits import FlagSet
from flagframe.operators import flags

SIZES = [1, 8, 9, 16, 17, 32, 33, 63, 64, 65, 130]


def bool_rows(n, rows=40, seed=1):
    rng = random.Random(seed)
    return [(i, *[rng.choice([True, False, None]) for _ in range(n)]) for i in range(rows)]


@pytest.mark.parametrize("n", SIZES)
def test_pack_unpack_is_identity(spark, n):
    names = [f"f{i}" for i in range(n)]
    rows = bool_rows(n)
    df = spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{x} boolean" for x in names))
    packed = flags.pack_flags(df, names)
    assert packed.columns == ["id", "flags"]
    assert packed.schema["flags"].dataType.simpleString() == bits.mask_type(n)
    back = {tuple(r) for r in flags.unpack_flags(packed, FlagSet(names)).collect()}
    assert back == {(r[0], *[bool(v) for v in r[1:]]) for r in rows}


def test_no_flags_give_zero(spark):
    packed = flags.pack_flags(spark.range(2), [])
    assert [r.flags for r in packed.collect()] == [0, 0]


@pytest.mark.parametrize("n", [5, 64, 65])
def test_filter_on_mask_equals_filter_on_columns(spark, n):
    names = [f"f{i}" for i in range(n)]
    rows = bool_rows(n, 200, 2)
    df = spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{x} boolean" for x in names))
    want = {"all_of": ["f0"], "any_of": [names[-1], "f1"], "none_of": ["f2"]}
    expected = {r[0] for r in rows if r[1] and (r[n] or r[2]) and not r[3]}
    by_mask = flags.filter_flags(flags.pack_flags(df, names), FlagSet(names), **want)
    by_source = flags.filter_flags(df, FlagSet(names), **want, definitions={x: F.col(x) for x in names})
    assert {r.id for r in by_mask.collect()} == expected
    assert {r.id for r in by_source.collect()} == expected


def test_source_predicates_reach_the_reader(spark, sf_dir):
    from flagframe.plans.queries import queries

    plan = queries()["flags_filter"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan and "GreaterThan(l_discount,0.0)" in plan
    assert "l_extendedprice" not in plan
    masked = queries()["flags_filter_mask"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: []" in masked


def test_update_needs_required_bits_and_keeps_other_keys(spark):
    df = spark.createDataFrame([(1, 0b0011), (2, 0b0100), (3, 0b0001)], "k bigint, flags smallint")
    updates = spark.createDataFrame(
        [(1, 0b1000, 0b0001, 0b0010, 0b0001), (2, 0b1000, 0, 0, 0b0011)],
        "k bigint, set_mask int, clear_mask int, toggle_mask int, require_mask int",
    )
    got = {r.k: r.flags for r in flags.update_flags(df, updates, "k").collect()}
    assert got == {1: 0b1000, 2: 0b0100, 3: 0b0001}
    only_set = flags.update_flags(df, updates.select("k", "set_mask"), "k")
    assert {r.k: r.flags for r in only_set.collect()} == {1: 0b1011, 2: 0b1100, 3: 0b0001}


def test_fold_equals_sequential_assignment(spark):
    rng = random.Random(3)
    names = ["a", "b", "c"]
    log = [(rng.randrange(20), rng.choice(names), rng.choice([True, False]), i) for i in range(400)]
    state: dict[int, dict[str, bool]] = {}
    for key, field, value, _ in log:
        state.setdefault(key, {})[field] = value
    expected = {k: sum(1 << i for i, n in enumerate(names) if v.get(n)) for k, v in state.items()}
    rng.shuffle(log)
    df = spark.createDataFrame(log, "key bigint, field string, value boolean, seq bigint").repartition(5)
    assert {r.key: r.flags for r in flags.fold_assignments(df, FlagSet(names), "key").collect()} == expected


def test_union_does_not_depend_on_partitions(spark):
    rows = [(i % 7, 1 << (i * i % 11)) for i in range(500)]
    results = []
    for n in (1, 3, 8):
        df = spark.createDataFrame(rows, "k int, flags bigint").repartition(n)
        results.append({r.k: r.flags for r in flags.union_flags(df, ["k"]).collect()})
    assert results[0] == results[1] == results[2]


def test_many_writers_set_two_bits(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 2 == 0, 2).otherwise(4).alias("flags"))
    assert flags.union_flags(df, []).first().flags == 6


def test_decode_cases(spark):
    named = FlagSet(["auth", "sanitize", "sanitize_body"], first_bit=1)
    df = spark.createDataFrame([(0,), (2,), (6,), (14,), (3,), (1,), (48,), (None,)], "flags int")
    got = [r.flag_names for r in flags.decode_flags(df, named).collect()]
    assert got == ["none", "auth", "auth|sanitize", "auth|sanitize|sanitize_body", "auth", "unknown(0x1)", "unknown(0x30)", None]
    sorted_names = FlagSet(["running", "retrying", "completed"], first_bit=1)
    got = flags.decode_flags(df, sorted_names, by_name=True, unknown="none").collect()
    assert [r.flag_names for r in got][:4] == ["none", "running", "retrying|running", "completed|retrying|running"]
    assert got[5].flag_names == "none"


def test_flags_from_map(spark):
    from flagframe.plans.tables import LEGACY_ALIASES, LEGACY_SET

    rows = [
        ({"auth": True, "sanitize": False},),
        ({"validateAndSanitize": True, "sanitize_body": False, "validateAndSanitizeBody": True},),
        ({"other": True, "auth": None},),
        ({},),
        (None,),
    ]
    df = spark.createDataFrame(rows, "m map<string,boolean>")
    got = [r.flags for r in flags.flags_from_map(df, "m", LEGACY_SET, LEGACY_ALIASES).collect()]
    assert got == [2, 12, 0, 0, 0]


def test_flag_counts(spark):
    df = spark.createDataFrame([("x", 3), ("x", 1), ("y", 0), ("y", -1)], "g string, flags bigint")
    rows = flags.flag_counts(df, FlagSet(["a", "b"]), by=["g"]).collect()
    assert {(r.g, r.flag): (r.rows_total, r.bits_total, r.rows_set) for r in rows} == {
        ("x", "a"): (2, 3, 2),
        ("x", "b"): (2, 3, 1),
        ("y", "a"): (2, 64, 1),
        ("y", "b"): (2, 64, 1),
    }


def test_dictionary_bits_widths_and_names(spark):
    rows = [("f.x", "Config", i, f"B{i}", "bool" if i % 2 else "string", 5, "pkg") for i in range(20)]
    rows += [("f.x", "Big", i, f"B{i}", "bool", 9, "pkg") for i in range(70)]
    fields = spark.createDataFrame(
        rows, "file string, struct_name string, pos int, field string, type string, line int, package string"
    )
    d = flags.flag_dictionary(fields).collect()
    config = {r.field: (r.flag_name, r.bit, r.width) for r in d if r.struct_name == "Config"}
    assert config["B1"] == ("FlagConfig_B1", 0, 16) and config["B19"] == ("FlagConfig_B19", 9, 16)
    assert sorted(r.bit for r in d if r.struct_name == "Big") == list(range(70))
    named = flags.flag_dictionary(fields, ["file", "package", "struct_name"], package="package", min_flags=11)
    assert {r.flag_name.rsplit("_", 1)[0] for r in named.collect()} == {"Flagpkg_Big"}


def test_dispatch_takes_first_listed_bit(spark):
    df = spark.createDataFrame([(0b110,), (0b100,), (0b001,), (0,)], "flags int")
    got = [r.action for r in flags.dispatch_bits(df, [(1, "b"), (2, "c")]).collect()]
    assert got == ["b", "c", None, None]


def test_stage_completion(spark):
    rows = [(1, 0), (1, 1), (1, 2), (2, 0), (2, 2), (3, None)]
    df = spark.createDataFrame(rows, "k int, stage int")
    got = {r.k: (r.stages, r.complete) for r in flags.stage_completion(df, "k", "stage").collect()}
    assert got == {1: (7, True), 2: (5, False), 3: (0, False)}
    share = flags.completion_share(flags.stage_completion(df, "k", "stage")).first()
    assert (share["keys"], share.complete_keys) == (3, 1)


def test_signed_helpers(spark):
    assert FlagSet([f"f{i}" for i in range(64)]).value("f63") == -(1 << 63)
    df = spark.createDataFrame(
        [("0x000000000000000b",), ("0x0abc00001f90",), ("0xffffffffffffffff",), ("0x8000000000000000",), ("12",), ("0x",), (None,)],
        "h string",
    )
    got = [r.v for r in df.select(bits.hex_to_bigint(F.col("h")).alias("v")).collect()]
    assert got == [11, 11802570137488, -1, -(1 << 63), None, None, None]


@pytest.mark.parametrize("n", SIZES)
def test_masks_of_any_width(spark, n):
    """Update, union, counts, decode and dispatch against plain sets of flags."""
    names = [f"f{i}" for i in range(n)]
    known, rows = FlagSet(names), bool_rows(n, 60, 7)
    df = spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{x} boolean" for x in names))
    packed = flags.pack_flags(df, names).withColumn("g", F.col("id") % 4)
    own = {r[0]: {names[i] for i, v in enumerate(r[1:]) if v} for r in rows}
    decoded = lambda some: "|".join(x for x in names if x in some) or "none"

    def folded(fold):
        got = flags.decode_flags(fold(packed, ["g"], flags=known), known).collect()
        return {r.g: r.flag_names for r in got}

    groups = {g: [own[i] for i in own if i % 4 == g] for g in range(4)}
    assert folded(flags.union_flags) == {g: decoded(set.union(*s)) for g, s in groups.items()}
    assert folded(flags.intersect_flags) == {g: decoded(set.intersection(*s)) for g, s in groups.items()}
    odd = {g: {x for x in names if sum(x in one for one in s) % 2} for g, s in groups.items()}
    assert folded(flags.parity_flags) == {g: decoded(x) for g, x in odd.items()}
    counts = {r.flag: (r.rows_set, r.bits_total) for r in flags.flag_counts(packed, known).collect()}
    assert counts == {x: (sum(x in s for s in own.values()), sum(map(len, own.values()))) for x in names}

    toggled, needed = {names[0], names[-1]}, {names[n // 2]}
    masks = {k: [bits.pack(known, {x: F.lit(True) for x in some})] for k, some in (("toggle_mask", toggled), ("require_mask", needed))}
    updates = packed.select("id", *[c[0].alias(k) for k, c in masks.items()])
    after = flags.decode_flags(flags.update_flags(packed, updates, "id", flags=known), known)
    cases = [(n - 1, "last"), (0, "first")]
    got = {r.id: (r.flag_names, r.action) for r in flags.dispatch_bits(after, cases).collect()}
    expected = {i: (s ^ toggled if needed <= s else s) for i, s in own.items()}
    assert got == {i: (decoded(s), "last" if names[-1] in s else "first" if names[0] in s else None) for i, s in expected.items()}


def test_unknown_bits_of_a_wide_mask(spark):
    known = FlagSet([f"f{i}" for i in range(70)])
    df = spark.createDataFrame([([0, 1 << 10],), ([0, 0],), ([1, 1 << 10],)], "flags array<bigint>")
    assert [r.flag_names for r in flags.decode_flags(df, known).collect()] == ["unknown(0x4000000000000000000)", "none", "f0"]


def test_many_flags_stay_out_of_one_huge_method(spark):
    for n, first in ((40, 3), (70, 0), (130, 2)):
        names = FlagSet([f"f{i}" for i in range(n)], first)
        conditions = {f"f{i}": f"id % {i + 2} = 0" for i in range(n)}
        df = spark.range(300).select("id", bits.pack(names, conditions).alias("flags"))
        got = {r.id: r.names for r in df.withColumn("names", bits.decode(F.col("flags"), names)).collect()}
        assert got == {k: "|".join(f"f{i}" for i in range(n) if k % (i + 2) == 0) or "none" for k in range(300)}
        # the project that packs is outside whole-stage code, where one method would hold all conditions
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert any(line.lstrip("+-: ").startswith("Project [id") for line in plan.splitlines())
