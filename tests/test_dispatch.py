import random

import pytest

from flagframe.operators.dispatch import apply_rules, compile_rules, residual_rules

SCHEMA = "chain_id int, position int, var string, op string, lit_kind string, value string, action string"


def compile_by_hand(rules, min_branches=3):
    chains = {}
    for rule in sorted(rules, key=lambda r: (r[0], r[1])):
        chains.setdefault(rule[0], []).append(rule)
    table, rest = {}, set()
    for chain, branches in chains.items():
        prefix = []
        for b in branches:
            if b[3] != "==" or b[4] != "string" or b[2] != branches[0][2]:
                break
            prefix.append(b)
        if len(prefix) < min_branches:
            prefix = []
        for b in prefix:
            table.setdefault((chain, b[5]), (b[2], b[6], b[1]))
        rest |= {(chain, b[1]) for b in branches[len(prefix):]}
    return table, rest


def check(spark, rules):
    df = spark.createDataFrame(rules, SCHEMA).repartition(3)
    table, rest = compile_by_hand(rules)
    got = {(r.chain_id, r.value): (r["var"], r.action, r.position) for r in compile_rules(df).collect()}
    assert got == table
    assert {(r.chain_id, r.position) for r in residual_rules(df).collect()} == rest


def test_random_chains(spark):
    rng = random.Random(11)
    rules = []
    for chain in range(150):
        for position in range(rng.randrange(1, 9)):
            rules.append(
                (
                    chain,
                    position,
                    rng.choice(["x", "x", "x", "x", "y"]),
                    rng.choice(["=="] * 6 + ["!="]),
                    rng.choice(["string"] * 8 + ["int"]),
                    rng.choice("abcde"),
                    f"do{position}",
                )
            )
    check(spark, rules)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_minimum_length(spark, n):
    check(spark, [(1, i, "x", "==", "string", f"v{i}", f"do{i}") for i in range(n)])


def test_break_in_the_middle_and_duplicates(spark):
    rules = [(1, i, "x", "==", "string", v, f"do{i}") for i, v in enumerate("aabca")]
    rules.append((1, 5, "y", "==", "string", "z", "other"))
    rules.append((1, 6, "x", "==", "string", "late", "lost"))
    check(spark, rules)


def test_apply_table_and_mapping(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    rules = spark.createDataFrame([(1, i, "x", "==", "string", v, v.upper()) for i, v in enumerate("acd")], SCHEMA)
    compiled = compile_rules(rules)
    assert {r.k: r.action for r in apply_rules(df, "k", compiled).collect()} == {"a": "A", "b": None, None: None}
    got = apply_rules(df, "k", compiled, default="else").collect()
    assert {r.k: r.action for r in got} == {"a": "A", "b": "else", None: "else"}
    got = apply_rules(df, "k", {"a": "A"}, default="else").collect()
    assert {r.k: r.action for r in got} == {"a": "A", "b": "else", None: "else"}


def test_apply_many_chains(spark):
    rules = spark.createDataFrame(
        [(c, i, "x", "==", "string", v, f"{v}{c}") for c in (1, 2) for i, v in enumerate("abc")], SCHEMA
    )
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (None, "a"), (2, "z")], "c int, k string")
    got = apply_rules(df, "k", compile_rules(rules), chain="c").collect()
    assert {(r.c, r.k): r.action for r in got} == {(1, "a"): "a1", (2, "a"): "a2", (3, "a"): None, (None, "a"): None, (2, "z"): None}
