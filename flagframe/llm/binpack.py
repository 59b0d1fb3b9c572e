"""Operator 10: packing token sequences by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens. Which pieces share a sequence
depends on their lengths alone, so the packing is planned on the histogram of lengths,
which has at most ``capacity`` rows however large the input is. The plan opens a sequence
with the longest piece left and fills it by the fullest combination of the lengths that are
left: a subset-sum over them, with reachable sums as the bits of one integer. The
combination found is removed as often as the counts allow, so the number of steps follows
the lengths and not the documents.

Pieces are numbered within their length (per partition while they are written, then by the
partitions' totals), and the number tells sequence and offset from the plan. No text is
shuffled; the pieces' numbers meet the totals of their own partition, grouped by it, so that
nothing that grows with the input is broadcast or collected.

Defined cases: a null or empty text is the end id alone; repeated rows are packed
as often as they occur; an empty table has no pieces. Sequence numbers depend on how the
table is read, the number of sequences does not.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flagframe.llm.batches import bounded, lean
from flagframe.llm.tokens import END_ID, worker_tokenizer
from flagframe.session import staged

CAPACITY = 4096
RANK_BITS = 48

_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int64()), ("turn", pa.int64())]
)


def cut(size: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document; only longer documents are cut."""
    for start in range(0, size, capacity):
        yield start, min(capacity, size - start)


def _pieces(capacity: int, tokenizer: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        words = worker_tokenizer(tokenizer)
        end = END_ID.to_bytes(4, "little")
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, coded in zip(batch.column(0).to_pylist(), words.encode_all(batch.column(1).to_pylist())):
                ids = coded + end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)] if rows else [pa.array([], f.type) for f in _PIECES], schema=_PIECES)

    return run


# --- the plan -------------------------------------------------------------------------------


def fullest(counts: np.ndarray, lengths: list[int], room: int) -> list[tuple[int, int]]:
    """The (length, times) with the largest sum of at most ``room``, longer lengths tried first.

    Bit s of ``reach`` says that s can be made of the lengths seen so far.
    """
    limit = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        if length > room:
            continue
        left, copies = min(int(counts[length]), room // length), 1
        while left:
            take = min(copies, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & limit
            left -= take
            copies *= 2
        if reach >> room:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return sorted(chosen.items(), reverse=True)


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of bins, [(length, times), ...]) for every combination used."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    plan = []
    lengths = [int(x) for x in np.flatnonzero(counts)[::-1]]
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        rest = fullest(counts, lengths, capacity - longest)
        counts[longest] += 1
        bin_ = dict(rest)
        bin_[longest] = bin_.get(longest, 0) + 1
        times = min(int(counts[length]) // k for length, k in bin_.items())
        for length, k in bin_.items():
            counts[length] -= times * k
        plan.append((times, sorted(bin_.items(), reverse=True)))
        lengths = [x for x in lengths if counts[x]]
    return plan


class Places:
    """Where the r-th piece of a length goes: intervals of ranks, searched by (length, rank)."""

    def __init__(self, plan: list[tuple[int, list[tuple[int, int]]]]):
        given: dict[int, int] = {}
        rows, base = [], 0
        for times, items in plan:
            offset = 0
            for length, k in items:
                first = given.get(length, 0)
                rows.append((length, first, k, base, offset))
                given[length] = first + times * k
                offset += length * k
            base += times
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 5)
        self.length, self.first, self.k, self.base, self.offset = table.T
        self.bins = base

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted((self.length << RANK_BITS) + self.first, (length << RANK_BITS) + rank, side="right") - 1
        inside = rank - self.first[row]
        return self.base[row] + inside // self.k[row], self.offset[row] + inside % self.k[row] * length


def _placed(places: Places, names: list[str], capacity: int):
    def run(part: pd.DataFrame, bases: pd.DataFrame) -> pd.DataFrame:
        first = np.zeros(capacity + 1, np.int64)
        first[bases.length.to_numpy()] = bases.base.to_numpy()
        sequence, offset = places.find(part.length.to_numpy(), first[part.length.to_numpy()] + part.turn.to_numpy())
        return part.assign(sequence_id=sequence, offset=offset)[names]

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """The pieces of all documents, written once, numbered within partition and length."""
    texts = bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, turn long"
    return staged(texts.mapInArrow(lean(_pieces(capacity, tokenizer)), schema), "pack-pieces")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut_ = pieces(docs, capacity, tokenizer)
    totals = staged(cut_.groupBy("part", "length").count(), "pack-lengths")
    histogram = {r["length"]: r["n"] for r in totals.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    places = Places(plan_bins(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    # a group holds the pieces that one task cut, as bounded as its split of the input, and at most a row per length beside them
    return cut_.groupBy("part").cogroup(base.groupBy("part")).applyInPandas(_placed(places, names, capacity), schema)
