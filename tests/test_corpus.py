import random

import pytest
from pyspark.sql import functions as F

from flagframe.operators import corpus
from flagframe.operators.flags import flag_dictionary

CONTEXT = "file string, type string, name string, complexity int, start_line int, end_line int"

# A small program described by hand: calls per function, and its nine lone ifs.
FUNCTIONS = [
    ("useConvertedBools", 57, 67, 3, 3),
    ("returnConvertedBools", 69, 71, 0, 0),
    ("checkConvertedBools", 73, 75, 0, 0),
    ("receiveBoolArgs", 77, 87, 3, 3),
    ("testStringObfuscatedValues", 89, 92, 0, 2),
    ("testConstStringObfuscatedValues", 94, 112, 0, 16),
    ("main", 114, 174, 3, 30),
]
IF_LINES = [58, 61, 64, 78, 81, 84, 132, 136, 140]


def test_program_contexts(spark):
    owners = spark.createDataFrame(
        [("m", n, a, b) for n, a, b, _, _ in FUNCTIONS], "file string, name string, start_line int, end_line int"
    )
    nodes = [("m", line, "if") for line in IF_LINES]
    nodes += [("m", a + 1 + i % (b - a), "call") for _, a, b, _, calls in FUNCTIONS for i in range(calls)]
    placed = corpus.assign_owners(spark.createDataFrame(nodes, "file string, line int, kind string"), owners)
    keyed = placed.select("file", F.col("owner").alias("name"), "kind")
    scores = corpus.weighted_complexity(keyed, ["file", "name"], owners)
    got = {r.name: r.complexity for r in scores.collect()}
    assert got == {
        "useConvertedBools": 10, "returnConvertedBools": 1, "checkConvertedBools": 1, "receiveBoolArgs": 10,
        "testStringObfuscatedValues": 3, "testConstStringObfuscatedValues": 17, "main": 37,
    }
    functions = owners.join(scores, ["file", "name"]).select(
        "file", F.lit("function").alias("type"), "name", F.col("complexity").cast("int").alias("complexity"), "start_line", "end_line"
    )
    others = [("m", "struct", "Config", 6, 5, 12)]
    others += [("m", "if_chain", f"if_chain_line_{x}", 1, x, x + 2) for x in IF_LINES]
    contexts = corpus.score_contexts(functions.unionByName(spark.createDataFrame(others, CONTEXT)))
    assert contexts.count() == 18
    eligible = corpus.select_contexts(contexts, eligible=True)
    assert {(r.type, r.name) for r in eligible.collect()} == {
        ("struct", "Config"), ("function", "returnConvertedBools"), ("function", "checkConvertedBools"),
        ("function", "testStringObfuscatedValues"), ("auth_logic", "checkConvertedBools"),
    }
    simple = corpus.select_contexts(contexts, eligible=True, simple=True)
    assert {(r.type, r.name, r.complexity) for r in simple.collect()} == {
        ("function", "checkConvertedBools", 1), ("auth_logic", "checkConvertedBools", 8),
    }
    states = corpus.expand_states(eligible, ["file", "name"])
    assert states.where("type = 'function'").count() == 9 and states.where("type = 'auth_logic'").count() == 3


def test_nodes_outside_every_owner(spark):
    owners = spark.createDataFrame([("m", "f", 5, 8), ("m", "g", 20, 20)], "file string, name string, start_line int, end_line int")
    nodes = spark.createDataFrame([("m", x, "if") for x in (1, 5, 8, 9, 20, 21)] + [("n", 6, "if")], "file string, line int, kind string")
    got = {(r.file, r.line): r.owner for r in corpus.assign_owners(nodes, owners).collect()}
    assert got == {("m", 1): None, ("m", 5): "f", ("m", 8): "f", ("m", 9): None, ("m", 20): "g", ("m", 21): None, ("n", 6): None}


def test_owners_in_one_hot_file(spark):
    rng = random.Random(4)
    starts = sorted(rng.sample(range(0, 3000, 10), 100))
    owners = [("hot", f"f{s}", s, s + rng.randrange(10)) for s in starts]
    nodes = [("hot", rng.randrange(3000), "if") for _ in range(400)]
    expected = {}
    for _, line, _ in nodes:
        expected[line] = next((n for _, n, a, b in owners if a <= line <= b), None)
    got = corpus.assign_owners(
        spark.createDataFrame(nodes, "file string, line int, kind string"),
        spark.createDataFrame(owners, "file string, name string, start_line int, end_line int"),
    )
    assert {r.line: r.owner for r in got.collect()} == expected and got.count() == 400


def test_complexity_of_all_kinds(spark):
    kinds = ["if", "for", "range", "switch", "type_switch", "call", "other"]
    nodes = spark.createDataFrame([("f", k) for k in kinds], "name string, kind string")
    assert corpus.weighted_complexity(nodes, ["name"]).first().complexity == 1 + 2 + 3 + 3 + 2 + 2 + 1


def test_chain_lengths(spark):
    chains, links, expected = [1, 2, 3, 7, 64, 100], [], {}
    for c, n in enumerate(chains):
        for i in range(n):
            node = c * 1000 + i
            last = i == n - 1
            # Odd chains end in a plain else, a node that is no link itself.
            links.append((node, node + 1 if not last else (node + 500 if c % 2 else None)))
            expected[node] = n - i + (1 if c % 2 else 0)
    random.Random(1).shuffle(links)
    df = spark.createDataFrame(links, "id int, else_id int")
    assert {r.id: r.length for r in corpus.chain_lengths(df).collect()} == expected
    assert corpus.chain_lengths(df.limit(0)).count() == 0


def test_cyclic_chain_is_an_error(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id int, else_id int")
    with pytest.raises(ValueError, match="cycle"):
        corpus.chain_lengths(df)


def test_cyclic_chains_as_rows(spark):
    links = [(1, 2), (2, 3), (3, 1), (4, 5), (5, 2), (6, 6), (7, 8), (8, 9), (9, None), (10, 99)] + [(i, i + 1) for i in range(100, 200)] + [(200, 150)]
    found = {r.id: (r.length, r.status) for r in corpus.chain_status(spark.createDataFrame(links, "id int, else_id int")).collect()}
    cyclic = [*range(1, 7), *range(100, 201)]
    assert found == {i: (None, "cyclic") for i in cyclic} | {7: (3, "ended"), 8: (2, "ended"), 9: (1, "ended"), 10: (2, "ended")}


def _nested_by_pairs(nodes, owners):
    weight = corpus.NODE_WEIGHTS
    return sorted(
        (f, n, a, b, 1 + sum(weight.get(k, 0) for g, x, k in nodes if g == f and x is not None and a is not None and b is not None and a <= x <= b))
        for f, n, a, b in set(owners)
    )


def test_nested_and_overlapping_owners(spark):
    rng = random.Random(6)
    owners = [("hot", f"f{i}", a, a + rng.choice([0, 5, 400, 3000])) for i, a in enumerate(rng.choices(range(3000), k=120))]
    owners += [("hot", "f0", 10, 10), ("hot", "f0", 10, 10), ("other", "empty", 7, 3), ("none", "alone", 1, 9)]
    nodes = [("hot", rng.randrange(3200), rng.choice(["if", "for", "call", "other"])) for _ in range(900)] + [("other", 5, "if"), ("lost", 1, "if"), ("hot", 10, "if"), ("hot", 10, "for")]
    found = corpus.nested_complexity(
        spark.createDataFrame(nodes, "file string, line int, kind string"),
        spark.createDataFrame(owners, "file string, name string, start_line int, end_line int"),
    )
    assert sorted(map(tuple, found.collect())) == _nested_by_pairs(nodes, owners)


def test_nested_owners_of_empty_tables(spark):
    nodes = spark.createDataFrame([], "file string, line int, kind string")
    owners = spark.createDataFrame([("f", "n", 1, 2)], "file string, name string, start_line int, end_line int")
    assert [tuple(r) for r in corpus.nested_complexity(nodes, owners).collect()] == [("f", "n", 1, 2, 1)]
    assert corpus.nested_complexity(nodes, owners.limit(0)).count() == 0


def test_branch_counts_keep_empty_parents(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    children = spark.createDataFrame([(1,), (1,), (7,)], "parent int")
    got = {r.id: r.branches for r in corpus.branch_counts(parents, children, "id", "parent").collect()}
    assert got == {1: 2, 2: 0}


def test_candidates(spark):
    fields = spark.createDataFrame(
        [("a", "S", 0, "X", "bool", 5), ("a", "S", 1, "Y", "int", 6), ("a", "S", 2, "Z", "bool", 7), ("a", "T", 0, "N", "int", 9)],
        "file string, struct_name string, pos int, field string, type string, line int",
    )
    assert [tuple(r) for r in corpus.flag_candidates(fields).collect()] == [("a", "S", 2, 5)]
    assert corpus.flag_candidates(fields, min_flags=3).count() == 0


@pytest.mark.parametrize(
    "kind,name,complexity,eligible,simple",
    [
        ("function", "util", 3, True, False),
        ("function", "util", 2, True, True),
        ("function", "other", 1, True, False),
        ("function", "util", 4, False, False),
        ("if_chain", "c", 2, False, True),
        ("if_chain", "c", 4, True, True),
        ("if_chain", "c", 5, True, False),
        ("if_chain", "c", 11, False, False),
        ("struct", "MyConfig", 3, True, True),
        ("struct", "MyConfig", 4, True, False),
        ("struct", "Thing", 1, True, False),
        ("struct", "StateBits", 11, False, False),
        ("switch", "s", 3, True, True),
        ("switch", "s", 10, True, False),
    ],
)
def test_rules_of_scoring(spark, kind, name, complexity, eligible, simple):
    scored = corpus.score_contexts(spark.createDataFrame([("f", kind, name, complexity, 1, 2)], CONTEXT))
    assert scored.count() == 1 and scored.first().eligible is eligible
    assert corpus.select_contexts(scored, simple=True).count() == int(simple)


def test_auth_row_is_added_and_always_eligible(spark):
    scored = corpus.score_contexts(spark.createDataFrame([("f", "function", "DoLogin", 40, 1, 2)], CONTEXT))
    assert {(r.type, r.complexity, r.eligible) for r in scored.collect()} == {("function", 40, False), ("auth_logic", 8, True)}


def test_dependencies(spark):
    rows = [
        ("f", "function", "HTTPHandler", 1, 1, 1), ("f", "function", "plain", 1, 2, 2), ("f", "struct", "A", 1, 3, 3),
        ("f", "struct", "B", 1, 4, 4), ("g", "function", "handlerX", 1, 1, 1), ("h", "struct", "C", 1, 1, 1),
    ]
    contexts = spark.createDataFrame(rows, CONTEXT)
    got = {r.name: r.dependencies for r in corpus.link_dependencies(contexts).collect()}
    assert got == {"HTTPHandler": 2, "plain": 0, "A": 0, "B": 0, "handlerX": 0, "C": 0}
    assert [r.name for r in corpus.dependency_members(contexts).orderBy("start_line").collect()] == ["A", "B"]


def test_states_with_zero_branches_and_struct_fields(spark):
    contexts = spark.createDataFrame(
        [("f", "switch", "s0", 0), ("f", "if_chain", "c2", 2), ("f", "struct", "Config", 2)],
        "file string, type string, struct_name string, complexity int",
    )
    fields = spark.createDataFrame(
        [("f", "Config", 1, "Debug", "bool", 2), ("f", "Config", 2, "Trace", "bool", 3)],
        "file string, struct_name string, pos int, field string, type string, line int",
    )
    got = corpus.expand_states(contexts, ["file", "struct_name"], flag_dictionary(fields)).collect()
    assert {(r.struct_name, r.bit, r.state, r.condition, r.action) for r in got} == {
        ("c2", 0, "condition_0", "evaluate_condition_0", "execute_branch_0"),
        ("c2", 1, "condition_1", "evaluate_condition_1", "execute_branch_1"),
        ("Config", 0, "Debug", "SetDebug(true)", "Execute_Debug_Logic"),
        ("Config", 1, "Trace", "SetTrace(true)", "Execute_Trace_Logic"),
    }


def test_a_context_with_ten_million_branches(spark):
    contexts = spark.createDataFrame([("f", "switch", 10_000_000), ("f", "switch", 1), ("f", "if_chain", 0)], "file string, type string, complexity int")
    states = corpus.expand_states(contexts.withColumn("id", F.monotonically_increasing_id()), ["id"])
    assert states.count() == 10_000_001
    assert states.where("bit = 65536").select("state").first().state == "case_65536"
