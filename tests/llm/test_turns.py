import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from harness import differences, duck

from flagframe.llm import turns

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def plain_edits(row_kinds):
    """The least (cost, audit) for rows (initial, forced, cut), walking the grammar from the end."""
    after = {0: (0, ""), 3: (0, "")}
    for initial, forced, cut in reversed(row_kinds):
        after = closed(after)
        now = {}
        for state in range(4):
            found = []
            if state in after:
                found.append((after[state][0] + 3, "D" + after[state][1]))
            for c in "sua":
                to = NEXT.get((state, c))
                if not forced and to in after and (c == initial or c != "s"):
                    same = c == initial
                    found.append((after[to][0] + cut + (0 if same else 2), ("K" if same else "R") + after[to][1]))
            if found:
                now[state] = min(found)
        after = now
    return closed(after)[0]


def closed(after):
    """With insertions before what follows; three in a row never help."""
    for _ in range(3):
        for (state, c), to in NEXT.items():
            if c != "s" and to in after:
                found = (after[to][0] + 2, "I" + after[to][1])
                after = {**after, state: min(found, after.get(state, found))}
    return after


def plain(rows, damage=True):
    """{conv_id: result} of (conv_id, turn, role, text) rows."""
    one = lambda x: " " if x is None else str(x)
    conversations = {}
    for conv, turn, role, text in rows:
        held = conversations.setdefault(conv, [])
        role, text = one(role), one(text)
        code = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20 if damage else 9
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        held += [(turn is not None, turn or 0, "user" if code == 4 else role, hashlib.sha256(text.encode()).digest(), text)] * (2 if code == 3 else 1)
    out = {}
    for conv, held in conversations.items():
        held.sort(key=lambda r: r[:4])
        seen, kinds, counts = set(), [], [0, 0, 0]
        for *_, role, _, text in held:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            kinds.append((role[:1], fault in (0, 1), int(fault == 2)))
        known = [r[1] for r in held if r[0]]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [k[0] for k in kinds]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = plain_edits(kinds)
        lines, at, due = [], iter(held), "u"
        for edit in audit:
            if edit == "I":
                lines.append(f"{turns.FULL[due]}:")
            else:
                *_, role, _, text = next(at)
                if edit == "D":
                    continue
                lines.append(f"{role}:{text}" if edit == "K" else f"{turns.FULL[due]}:{text}")
            due = "u" if lines[-1][0] in "sa" else "a"
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def run(spark, rows, damage=True, parts=3):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost long, digest string")
    table = table.repartition(parts)
    found = (turns.damaged_structure(table) if damage else turns.structure(table, table)).collect()
    out = {r[0]: tuple(r)[1:] for r in found}
    assert len(out) == len(found)
    return out


def random_rows(rng, conversations, longest, words=("ok.", "fine!", "why?", "cut", "", " \t", "no stop", "yes.")):
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ["user", "assistant"][turn % 2]
            role = rng.choice(["system", "tool", None, "", "sys"]) if rng.random() < 0.1 else role
            text = rng.choice(words) if rng.random() < 0.3 else f"{rng.random()}" + rng.choice([".", "", "?"])
            rows.append((conv, turn + (rng.random() < 0.1), role, text))
    return rows


# --- alignment -----------------------------------------------------------------------------------


def states_of(pattern):
    """Plain edits for turns written as one character each, D for forced ones."""
    return plain_edits([(c.lower() if c != "D" else "u", c == "D", int(c.isupper() and c != "D")) for c in pattern])


def test_all_short_conversations():
    for n in range(5):
        for kinds in product("suaxUA", repeat=n):
            pattern = "".join(kinds)
            assert turns.whole(turns.block_edits(pattern)) == states_of(pattern)


@pytest.mark.parametrize("weights", [(1, 1, 1, 1, 1, 1), (0, 9, 1, 0, 3, 0), (5, 1, 1, 1, 1, 1)])
def test_blocks_join_to_the_whole(monkeypatch, weights):
    rng = random.Random(sum(weights))
    for _ in range(150):
        pattern = "".join(rng.choices("suaxUA", weights, k=rng.randint(1, 40)))
        expected = states_of(pattern)
        assert turns.whole(turns.block_edits(pattern)) == expected
        monkeypatch.setattr(turns, "BLOCK", rng.randint(1, 9))
        turns._KNOWN.clear()
        assert turns.whole(turns.edits_of(pattern)) == expected


def test_band_holds_every_least_alignment():
    rng = random.Random(2)
    for _ in range(100):
        pattern = "".join(rng.choices("suaxUA", k=rng.randint(1, 25)))
        for end in "ua":
            banded, full = turns.aligned(pattern, end), turns.Alignment(pattern, end, len(pattern) + 4)
            for odd in (False, True):
                assert banded.least(odd) == full.least(odd)
                least = [r for r in full.lengths(odd) if full.cost[0][r] == full.least(odd)]
                assert [full.audit(0, r) for r in least] == [banded.audit(0, r) for r in least]


def test_forced_deletions_come_before_insertions():
    rng = random.Random(4)
    for _ in range(200):
        kinds = "".join(rng.choices("suaxD", (1, 3, 3, 1, 4), k=rng.randint(0, 14)))
        cost, audit = turns.whole(turns.edits_of(kinds.replace("D", "")))
        assert (cost + 3 * kinds.count("D"), turns.with_forced(audit, kinds)) == states_of(kinds)


# --- tables ---------------------------------------------------------------------------------------


def test_matches_duckdb_on_conversations(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert differences(turns.damaged_structure(table), duck(sf_dir), turns.ORACLE) is None


@pytest.mark.parametrize("damage", [True, False])
def test_random_conversations(spark, damage):
    rows = random_rows(random.Random(9), 150, 12)
    assert run(spark, rows, damage) == plain(rows, damage)


def test_one_conversation_in_many_chunks(spark):
    rng = random.Random(1)
    rows = [(7, *r[1:]) for r in random_rows(rng, 1, 3)] + [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"{t}.", ""])) for t in range(900)]
    rows += random_rows(rng, 5, 4)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost long, digest string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = turns.summaries(turns.damaged(table)).where("conv_id = 7").count()
        found = run(spark, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert parts > 4
    assert found == plain(rows)


def test_cases(spark):
    rows = [
        (None, 0, "user", "a."), (None, None, None, None), (1, None, "user", "x."), (1, None, "user", "x."), (1, 3, "assistant", "y."), (2, 5, None, "z"),
        (3, 1, "user", "word " * 20_000 + "."), (3, 2, "assistant", "." + " " * 50_000), (4, 0, "", ""), (5, 0, "System", "Up."), (5, 1, "user", "é."),
        (6, 2, "user", "t."), (6, 2, "assistant", "t."), (6, 2, "assistant", "t"), (8, None, "user", " "),
    ]
    for damage in (True, False):
        assert run(spark, rows, damage) == plain(rows, damage)


def test_many_copies_of_one_turn(spark):
    rows = [(1, 0, "user", "same.")] * 3000 + [(1, 1, "assistant", "yes.")]
    found = run(spark, rows, damage=False)
    assert found == plain(rows, damage=False)
    assert found[1][6] == "K" + "D" * 2999 + "K"


def test_empty_and_dropped(spark):
    assert run(spark, []) == {}
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(dropped, 0, "user", "a.")]) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_lines(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c."), (2, 0, "assistant", "d.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    lines = sorted(tuple(r) for r in turns.repaired(table).collect())
    audits = {c: v[6] for c, v in plain(rows, damage=False).items()}
    assert audits == {1: "KIKK", 2: "IK"}
    assert lines == [(1, 0, "user", "a."), (1, 1, "assistant", ""), (1, 2, "user", "b."), (1, 3, "assistant", "c."), (2, 0, "user", ""), (2, 1, "assistant", "d.")]
