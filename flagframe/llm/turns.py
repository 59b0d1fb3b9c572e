"""Operator 11: repair of conversation structure by target alignment.

The role initials of a sound conversation are empty or an optional s and then ua repeated. Turns are
aligned to the target strings of that grammar by the Wagner-Fischer recurrence over the edits Keep,
Rerole, Delete and Insert, for every length a target may have: targets with the same
end share their columns, so one matrix per end holds all lengths. A first narrow band gives an incumbent
cost; as every step off the diagonal costs at least two, the incumbent says how wide
Ukkonen's band must be for no cheaper or equal alignment to lie outside. Of the lengths with
the least cost the audits are traced back, each the ASCII-least of its length, and compared.

Blank and duplicate turns must be deleted and stand in no alignment: their deletions come as early as
they can, which is ASCII-least, so they are put back between the edits found. The live
turns are aligned in blocks of at most ``BLOCK`` for every entry and exit state of the grammar, and blocks are
joined state by state. That is exact, audits included: audits of equal cost over the same turns are
never prefixes of each other, so the least of a block stays the least whatever follows.

Work is spread as follows. Turns without their texts (a digest and two marks stand for a text) are
counted per place, which folds exact copies before any shuffle, and the first place of each role and text is a
minimum. The places are range-partitioned by conversation and turn, so one conversation with most of
the rows lies in many tasks; each sends one summary per conversation, with its edits per
pair of states. Last, texts travel once, to the task of their conversation and sorted into its order, and are streamed
through the digest of the repaired conversation: its chain is the only serial part, and holds
no text. Texts are told apart by SHA-256.

Defined cases: a null conv_id, turn, role or text counts as one space where it is read as text; a null
conv_id is a conversation, a null turn comes first; turns with equal numbers are ordered by role,
then by the digest of the text; only the four columns are read, so extra columns of any
name do not matter; an empty table gives no rows; texts of any length are streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flagframe.session import staged

BLOCK = 64
ROWS_AT_ONCE = 512
CACHED_BLOCKS = 50_000
BLANKS = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE = 3, 2, 2
FAR = 1 << 60
FULL = {"u": "user", "a": "assistant"}

# States of the grammar: nothing yet, after s, after u, after a. A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
MOVES = [
    (START, START), (START, SYSTEM), (START, USER), (START, ASSISTANT), (SYSTEM, SYSTEM), (SYSTEM, USER), (SYSTEM, ASSISTANT),
    (USER, USER), (USER, ASSISTANT), (ASSISTANT, USER), (ASSISTANT, ASSISTANT),
]
Edits = dict[tuple[int, int], tuple[int, str]]  # by (entry, exit): cost and audit


# --- alignment ---------------------------------------------------------------------------------


def other(c: str) -> str:
    return "a" if c == "u" else "u"


class Alignment:
    """Turns against all targets that end in ``end``; ``cost[i][r]`` is that of the turns from i on and the last r characters.

    A turn is one character: its role initial (x for any but s, u and a), in upper case if truncated.
    """

    def __init__(self, turns: str, end: str, band: int):
        self.turns, self.end, self.band = turns, end, band
        self.kind = [t.lower() for t in turns]
        self.cut = [int(t.isupper()) for t in turns]
        n, step = len(turns), (end, other(end))
        self.cost: list[dict[int, int]] = [{} for _ in range(n + 1)]
        self.cost[n] = {r: INSERT * r for r in range(band + 1)}
        for i in range(n - 1, -1, -1):
            below, row, kind, cut = self.cost[i + 1], self.cost[i], self.kind[i], self.cut[i]
            for r in range(max(0, n - i - band), n - i + band + 1):
                best = below.get(r, FAR) + DELETE
                if r:
                    kept = below.get(r - 1, FAR) + cut + (0 if kind == step[(r - 1) & 1] else REROLE)
                    best = min(best, kept, row.get(r - 1, FAR) + INSERT)
                row[r] = best

    def audit(self, i: int, r: int) -> str:
        """The ASCII-least edits from there on: Delete, Insert, Keep, Rerole."""
        out, n, step = [], len(self.turns), (self.end, other(self.end))
        while i < n or r:
            cost = self.cost[i][r]
            if i < n and self.cost[i + 1].get(r, FAR) + DELETE == cost:
                out.append("D")
                i += 1
            elif r and self.cost[i].get(r - 1, FAR) + INSERT == cost:
                out.append("I")
                r -= 1
            else:
                out.append("K" if self.kind[i] == step[(r - 1) & 1] else "R")
                i, r = i + 1, r - 1
        return "".join(out)

    def lengths(self, odd: bool) -> list[int]:
        return [r for r in self.cost[0] if r and r & 1 == odd]

    def least(self, odd: bool) -> int:
        return min((self.cost[0][r] for r in self.lengths(odd)), default=FAR)


def aligned(turns: str, end: str) -> Alignment:
    """Wide enough that every least alignment, of odd and of even targets, lies in the band."""
    least_cost = sum(t.isupper() for t in turns)  # deleting a truncated turn still costs two more than keeping it
    narrow = Alignment(turns, end, 2)
    incumbent = max(narrow.least(False), narrow.least(True))
    band = (incumbent - least_cost) // 2
    return narrow if band <= 2 else Alignment(turns, end, band)


def block_edits(turns: str) -> Edits:
    """The least edits of a block for every entry and exit state."""
    n = len(turns)
    by_end = {e: aligned(turns, e) for e in "ua"}
    nothing = (DELETE * n, "D" * n)
    out: Edits = {(s, s): nothing for s in range(4)}

    def best(end: str, odd: bool) -> tuple[int, str]:
        table = by_end[end]
        cost = table.least(odd)
        return cost, min(table.audit(0, r) for r in table.lengths(odd) if table.cost[0][r] == cost)

    from_u = {USER: best("u", True), ASSISTANT: best("a", False)}  # targets that begin with u
    from_a = {USER: best("u", False), ASSISTANT: best("a", True)}
    for state, found in from_u.items():
        for entry in (START, SYSTEM, ASSISTANT):
            out[entry, state] = min(found, out.get((entry, state), found))
    for state, found in from_a.items():
        out[USER, state] = min(found, out.get((USER, state), found))
    for i, t in enumerate(turns):
        if t.lower() != "s":
            continue
        head = DELETE * i + t.isupper()
        ahead = "D" * i + "K"
        after = n - i - 1
        alone = (head + DELETE * after, ahead + "D" * after)
        out[START, SYSTEM] = min(alone, out.get((START, SYSTEM), alone))
        for state, end, odd in ((USER, "u", 1), (ASSISTANT, "a", 0)):
            row = by_end[end].cost[i + 1]
            known = out[START, state]
            for r, cost in row.items():
                if r and r & 1 == odd and head + cost <= known[0]:
                    known = min(known, (head + cost, ahead + by_end[end].audit(i + 1, r)))
            out[START, state] = known
    return out


def joined(left: Edits, right: Edits) -> Edits:
    out: Edits = {}
    for (p, q), (cost, audit) in left.items():
        for s in range(4):
            if (q, s) in right:
                more = right[q, s]
                found = (cost + more[0], audit + more[1])
                if (p, s) not in out or found < out[p, s]:
                    out[p, s] = found
    return out


def joined_all(parts: list[Edits]) -> Edits:
    """Pairwise, so that audits are copied log2(parts) times."""
    while len(parts) > 1:
        parts = [joined(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


_KNOWN: dict[str, Edits] = {}


def edits_of(turns: str) -> Edits:
    """Edits of live turns, aligned block by block; blocks met before are looked up."""
    parts = []
    for at in range(0, len(turns) or 1, BLOCK):
        block = turns[at : at + BLOCK]
        if block not in _KNOWN:
            if len(_KNOWN) >= CACHED_BLOCKS:
                _KNOWN.clear()
            _KNOWN[block] = block_edits(block)
        parts.append(_KNOWN[block])
    return joined_all(parts)


def whole(edits: Edits) -> tuple[int, str]:
    """The least edits that begin with nothing and end where a conversation may."""
    return min(edits[START, START], edits[START, ASSISTANT])


def with_forced(audit: str, kinds: str) -> str:
    """The audit of all turns: ``kinds`` has a D for every turn that must go, put before the insertions beside it."""
    out, at, n = [], 0, len(kinds)

    def forced(at: int) -> int:
        end = at
        while end < n and kinds[end] == "D":
            end += 1
        out.append(kinds[at:end])
        return end

    at = forced(0)
    for edit in audit:
        out.append(edit)
        if edit != "I":
            at = forced(at + 1)
    return "".join(out)


# --- turns without texts -------------------------------------------------------------------------


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def read(conversations: DataFrame) -> DataFrame:
    """The four columns that count; a null role or text reads as one space."""
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text_of("role").alias("role"), text_of("text").alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of the damage experiment: dropped, emptied, without stops, repeated, or with another role."""
    code = F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn"))) % 20
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    rows = read(conversations).withColumn("code", code).where("code <> 0")
    times = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))
    changed = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times"))
    return changed.select("conv_id", "turn", "role", "text", F.explode("times").alias("_")).drop("_")


PLACE = ["conv_id", "turn", "role", "digest"]


def with_digest(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text")


def places(turns: DataFrame) -> DataFrame:
    """Per place (turn, role, text) of a conversation: how many rows, whether one of them is live, and its marks.

    Live is the first of its role and text, unless it is blank.
    """
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    marked = with_digest(turns).withColumns({"blank": trimmed == "", "cut": ~F.right(trimmed, F.lit(1)).isin(".", "!", "?")})
    counted = marked.groupBy(*PLACE, "blank", "cut").agg(F.count(F.lit(1)).alias("rows"))
    first = counted.where(~F.col("blank")).groupBy("conv_id", "role", "digest", "blank", "cut")
    firsts = first.agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("_at"))
    firsts = firsts.select("conv_id", F.col("_at.turn").alias("turn"), "role", "digest", "blank", "cut", F.lit(0).cast("long").alias("rows"), F.lit(1).alias("live"))
    both = counted.withColumn("live", F.lit(0)).unionByName(firsts)
    return both.groupBy(*PLACE, "blank", "cut").agg(F.sum("rows").alias("rows"), F.max("live").alias("live"))


# --- summaries per conversation and chunk --------------------------------------------------------

_SUMMARY = pa.schema(
    [
        ("conv_id", pa.int64()), ("chunk", pa.int32()), ("kinds", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
        ("counts", pa.list_(pa.int64())), ("initials", pa.list_(pa.string())), ("turns", pa.list_(pa.int64())),
    ]
)
SUMMARY_SCHEMA = (
    "conv_id long, chunk int, kinds string, costs array<long>, audits array<string>, counts array<long>, initials array<string>, turns array<long>"
)
_FIELDS = ["chunk", "kinds", "costs", "audits", "counts", "initials", "turns"]


class Summary:
    """One conversation, or its part in a chunk, read place by place.

    counts: blank, duplicate, truncated, illegal pairs, different turns; initials: first and last; turns: least and greatest.
    """

    def __init__(self, conv_id: int | None):
        self.conv_id, self.kinds, self.live = conv_id, [], []
        self.counts, self.first, self.last = [0] * 5, None, None
        self.turns: list[int] = []

    def add(self, turn: int | None, role: str, rows: int, blank: bool, cut: bool, live: int) -> None:
        initial = role[:1]
        counts = self.counts
        if self.last is None:
            self.first = initial
        else:
            counts[3] += legal(self.last, initial) is False
        counts[3] += (rows - 1) * (not legal(initial, initial))
        self.last = initial
        if turn is not None and (not self.turns or self.turns[1] != turn):
            self.turns = [self.turns[0] if self.turns else turn, turn]
            counts[4] += 1
        if live:
            counts[2] += cut
            turn_kind = initial if initial in ("s", "u", "a") else "x"
            self.live.append(turn_kind.upper() if cut else turn_kind)
            self.kinds.append(turn_kind)
        counts[0 if blank else 1] += rows - live
        self.kinds.append("D" * (rows - live))

    def row(self) -> tuple:
        edits = edits_of("".join(self.live))
        found = [edits.get(move, (-1, "")) for move in MOVES]
        return self.conv_id, None, "".join(self.kinds), [c for c, _ in found], [a for _, a in found], self.counts, [self.first, self.last], self.turns


def legal(one: str, two: str) -> bool:
    return one + two in ("su", "ua", "au")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries of sorted places; a task is a chunk."""
    from pyspark import TaskContext

    chunk, held, out = TaskContext.get().partitionId(), None, []

    def table() -> pa.RecordBatch:
        columns = [list(c) for c in zip(*out)]
        columns[1] = [chunk] * len(out)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SUMMARY)], schema=_SUMMARY)

    for batch in batches:
        for conv_id, *place in zip(*(c.to_pylist() for c in batch.columns)):
            if held is None or conv_id != held.conv_id:
                if held is not None:
                    out.append(held.row())
                    if len(out) >= ROWS_AT_ONCE:
                        yield table()
                        out = []
                held = Summary(conv_id)
            held.add(*place)
    if held is not None:
        out.append(held.row())
    if out:
        yield table()


def summaries(turns: DataFrame) -> DataFrame:
    """One row per conversation and chunk; a conversation is in many chunks only where it fills them."""
    chunks = places(read(turns)).repartitionByRange(*PLACE).sortWithinPartitions(*PLACE)
    return staged(chunks.select("conv_id", "turn", "role", "rows", "blank", "cut", "live").mapInArrow(_summaries, SUMMARY_SCHEMA), "turn-summaries")


# --- repaired conversations ------------------------------------------------------------------------

RESULT_SCHEMA = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
_RESULT = pa.schema(
    [("conv_id", pa.int64()), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())]
)
_LINES = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.binary())])
LINES_SCHEMA = "conv_id long, place long, role string, text binary"


class Repair:
    """Joins the summaries of a conversation and applies its audit to the turns that follow in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.parts = conv_id, []
        self.audit = None

    def decide(self) -> None:
        """All summaries are there: the counts, the cost and the audit of the whole conversation."""
        self.counts, kinds, last, turns = [0] * 5, [], None, []
        for part in self.parts:
            self.counts = [a + b for a, b in zip(self.counts, part["counts"])]
            first, end = part["initials"]
            self.counts[3] += last is not None and not legal(last, first)
            last = end
            if part["turns"]:
                self.counts[4] -= bool(turns) and turns[1] == part["turns"][0]
                turns = [turns[0] if turns else part["turns"][0], part["turns"][1]]
            kinds.append(part["kinds"])
        self.kinds = "".join(kinds)
        edits = [{m: (c, a) for m, c, a in zip(MOVES, p["costs"], p["audits"]) if c >= 0} for p in self.parts]
        cost, audit = whole(joined_all(edits)) if edits else (0, "")
        self.parts = []
        self.gaps = turns[1] - turns[0] + 1 - self.counts[4] if turns else 0
        self.audit = with_forced(audit, self.kinds)
        self.cost = cost + DELETE * self.kinds.count("D")
        self.at, self.place, self.next = 0, 0, "u"

    def inserted(self) -> Iterator[tuple[int, str, bytes]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield self.line(FULL[self.next], b"", self.next)
            self.at += 1

    def line(self, role: str, text: bytes, initial: str) -> tuple[int, str, bytes]:
        self.place += 1
        self.next = "u" if initial == "s" else other(initial)
        return self.place - 1, role, text

    def lines(self, role: str, text) -> Iterator[tuple[int, str, bytes]]:
        """The lines of the repaired conversation that the next turn gives."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            yield self.line(role, text, role[:1])
        elif edit == "R":
            yield self.line(FULL[self.next], text, self.next)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Repair, Iterator]]:
    """Per sorted row its conversation and the lines it gives; a conversation ends with a row of no lines left to insert."""
    held = None
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            some = batch.slice(at, ROWS_AT_ONCE)
            heads, roles, texts = some.column(1).to_pylist(), some.column(2).to_pylist(), some.column(3)
            for i, conv_id in enumerate(some.column(0).to_pylist()):
                if held is None or conv_id != held.conv_id:
                    if held is not None:
                        yield from _ended(held)
                    held = Repair(conv_id)
                if heads[i] is not None:
                    if heads[i]["kinds"] is not None:
                        held.parts.append(heads[i])
                    continue
                if held.audit is None:
                    held.decide()
                yield held, held.lines(roles[i], texts[i].as_buffer())
    if held is not None:
        yield from _ended(held)


def _ended(held: Repair) -> Iterator[tuple[Repair, Iterator | None]]:
    if held.audit is None:
        held.decide()
    yield held, held.inserted()
    yield held, None


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest, out = hashlib.sha256(), []

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _RESULT)], schema=_RESULT)

    for repair, lines in _streams(batches):
        if lines is None:
            blank, duplicate, truncated, illegal, _ = repair.counts
            out.append((repair.conv_id, repair.gaps, blank, duplicate, truncated, illegal, repair.cost, repair.audit, digest.hexdigest()))
            digest = hashlib.sha256()
            if len(out) >= ROWS_AT_ONCE:
                yield table()
                out = []
            continue
        for place, role, text in lines:
            digest.update((f"\n{role}:" if place else f"{role}:").encode())
            digest.update(text)
    if out:
        yield table()


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _LINES)], schema=_LINES)

    for repair, lines in _streams(batches):
        out += [(repair.conv_id, place, role, bytes(text)) for place, role, text in lines or ()]
        if len(out) >= ROWS_AT_ONCE:
            yield table()
            out = []
    if out:
        yield table()


def _ordered(turns: DataFrame, conversations: DataFrame | None) -> DataFrame:
    """Summaries and then turns of each conversation, sorted, each conversation in one task."""
    turns = read(turns)
    found = summaries(turns)
    empty = F.lit(None).cast("struct<chunk:int,kinds:string,costs:array<bigint>,audits:array<string>,counts:array<bigint>,initials:array<string>,turns:array<bigint>>")
    nothing = {"role": F.lit(None).cast("string"), "text": F.lit(None).cast("binary"), "turn": F.lit(None).cast("long"), "digest": F.lit(None).cast("binary")}
    heads = found.select("conv_id", F.struct(*_FIELDS).alias("head"), F.col("chunk").alias("_rank")).withColumns(nothing)
    texts = with_digest(turns).select("conv_id", empty.alias("head"), F.lit((1 << 31) - 1).alias("_rank"), "role", F.col("text").cast("binary").alias("text"), "turn", "digest")
    rows = heads.unionByName(texts)
    if conversations is not None:  # conversations that lost all their rows
        ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        none = F.struct(*[F.lit(None).cast(found.schema[f].dataType).alias(f) for f in _FIELDS])
        rows = rows.unionByName(ids.select("conv_id", none.alias("head"), F.lit(-1).alias("_rank")).withColumns(nothing))
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "_rank", "turn", "role", "digest")
    return placed.select("conv_id", "head", "role", "text")


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text."""
    lines = _ordered(turns, None).mapInArrow(_lines, LINES_SCHEMA)
    return lines.select("conv_id", "place", "role", F.col("text").cast("string"))


def structure(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Per conversation of ``turns`` (and of ``conversations``): gaps, faults, cost, audit and the digest of its repair."""
    return _ordered(turns, conversations).mapInArrow(_digests, RESULT_SCHEMA)


def damaged_structure(conversations: DataFrame) -> DataFrame:
    """The faults and repairs of all conversations after the damage experiment."""
    return structure(damaged(conversations), conversations)


# --- twin --------------------------------------------------------------------------------------------


def _step(state: str, edit: str, cost: str, line: str | None = None) -> str:
    """The state after one more edit, NULL if the state is not reached."""
    text = f"{state}.t" if line is None else f"{state}.t || CASE WHEN {state}.t = '' THEN '' ELSE chr(10) END || {line}"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {text}}} END"


def _least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


def _insert(state: str, role: str) -> str:
    return _step(state, "I", str(INSERT), f"'{role}:'")


def _turn(initial: str, before: list[int]) -> list[str]:
    """A live turn that becomes ``initial`` from any of the states ``before``."""
    out = []
    for p in before:
        out.append(f"CASE WHEN x.kind IN ('t', 'k') AND x.initial = '{initial}' THEN {_step(f'n{p}', 'K', 'x.cut', 'x.line')} END")
        if initial in FULL:
            changed = f"'{FULL[initial]}:' || x.text"
            out.append(f"CASE WHEN x.kind IN ('t', 'k') AND x.initial <> '{initial}' THEN {_step(f'n{p}', 'R', f'{REROLE} + x.cut', changed)} END")
    return out


_STATE = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
_CLOSED = ", ".join(
    [
        "s0 AS n0", "s1 AS n1", f"{_least('s2', *[_insert(f's{p}', 'user') for p in (0, 1, 3)])} AS n2",
        f"{_least('s3', _insert('s2', 'assistant'), _insert('u0', 'assistant'), _insert('u1', 'assistant'))} AS n3",
    ]
)
_BEFORE = f"(SELECT *, {_insert('s0', 'user')} AS u0, {_insert('s1', 'user')} AS u1 FROM walk)"

ORACLE = f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g
  FROM conversations),
coded AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda c: ord(c)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE (v >> 1) + z END)), 4294967295::BIGINT) % 20 AS code
  FROM named),
damaged AS (
  SELECT g, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM coded WHERE code <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed, left(role, 1) AS initial
  FROM damaged),
kinds AS (
  SELECT *, CASE WHEN trimmed = '' THEN 'b' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'd'
      WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS kind,
    coalesce(lag(initial) OVER (PARTITION BY g ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM numbered),
turns AS (SELECT *, (kind = 't')::BIGINT AS cut, role || ':' || text AS line FROM kinds),
walk AS (
  SELECT g, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}}::{_STATE} AS s0, NULL::{_STATE} AS s1, NULL::{_STATE} AS s2, NULL::{_STATE} AS s3
  FROM (SELECT DISTINCT g FROM named)
  UNION ALL
  SELECT x.g, x.i, {_step('n0', 'D', str(DELETE))}, {_least(_step('n1', 'D', str(DELETE)), *_turn('s', [0]))},
    {_least(_step('n2', 'D', str(DELETE)), *_turn('u', [0, 1, 3]))}, {_least(_step('n3', 'D', str(DELETE)), *_turn('a', [2]))}
  FROM (SELECT g, i, {_CLOSED} FROM {_BEFORE}) w JOIN turns x ON x.g = w.g AND x.i = w.i + 1),
ends AS (
  SELECT g, {_least('n0', 'n3')} AS e
  FROM (SELECT g, i, {_CLOSED} FROM {_BEFORE}) QUALIFY row_number() OVER (PARTITION BY g ORDER BY i DESC) = 1),
counts AS (
  SELECT g, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (kind = 'b') AS blank, count(*) FILTER (kind = 'd') AS duplicate,
    count(*) FILTER (kind = 't') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM turns GROUP BY g)
SELECT n.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, e.c AS cost, e.a AS audit, sha256(e.t) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM named) n JOIN ends USING (g) LEFT JOIN counts USING (g)
"""
