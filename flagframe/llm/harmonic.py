"""Operator 13: harmonic packing of token sequences.

Lengths are partitioned into reciprocal-capacity classes: class k holds the lengths of
(capacity / (k + 1), capacity / k], and a sequence of class k takes exactly k pieces, so whatever they
are they fit. A worker keeps one open sequence per class, which are about
2 * sqrt(capacity), closes it at its k-th piece and asks nobody: no length is sorted, searched or sent.

The plain method pads much where a length lies low in its class. As documents may be cut, a length
stays whole only where k such pieces would leave at most ``waste`` of the sequence empty. Else
the longest length of the next class is cut off, which fills its sequences but for a rest of the
division, and what is left goes the same way. Short lengths are a class each, so this ends after
few cuts (2.2 pieces a document at the default).

What lies in the open sequences when a task ends, less than a sequence per class, is poured together
in class order and cut at the capacity; the last one is closed at powers of two, where
no padding is due. So the number of tasks costs no padding either.

Defined cases: a null or empty text is the end id alone; a document of any length is held alone while
it is cut; repeated rows are packed as often as they occur; a null doc_id is kept; an empty table
has no pieces; only ``doc_id`` and ``text`` are read, so extra columns of any name do not matter.
Sequence numbers are unique, and depend on how the table is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagframe.llm.tokens import END_ID, SCAN_BOUNDS, worker_tokenizer

CAPACITY = 2048
WASTE = 0.03
TEXTS_AT_ONCE = 1024
PIECES_AT_ONCE = 4096
PART_BITS = 32

_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
    ]
)
PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

Piece = tuple[int | None, int, int, bytes]  # doc_id, start, doc_tokens, ids of four bytes each


@cache
def cuts(rest: int, capacity: int, waste: float) -> tuple[int, ...]:
    """Lengths of the pieces of ``rest`` < capacity tokens."""
    lengths = []
    while rest:
        per_bin = capacity // rest
        if capacity - per_bin * rest <= waste * capacity:
            lengths.append(rest)
            break
        lengths.append(capacity // (per_bin + 1))
        rest -= lengths[-1]
    return tuple(lengths)


def lengths_of(tokens: int, capacity: int = CAPACITY, waste: float = WASTE) -> tuple[int, ...]:
    """Lengths of the pieces of a document, in order."""
    return (capacity,) * (tokens // capacity) + cuts(tokens % capacity, capacity, waste)


class Classes:
    """The open sequences of a worker, one per class; full ones are handed over as rows."""

    def __init__(self, capacity: int, first_sequence: int = 0):
        self.capacity, self.next = capacity, first_sequence
        self.open: dict[int, list[Piece]] = {}

    def put(self, piece: Piece) -> list[tuple]:
        per_bin = self.capacity * 4 // len(piece[3])
        held = self.open.setdefault(per_bin, [])
        held.append(piece)
        if len(held) < per_bin:
            return []
        del self.open[per_bin]
        return self._sequence(held)

    def _sequence(self, pieces: list[Piece]) -> list[tuple]:
        rows, offset, number = [], 0, self.next
        self.next += 1
        for doc_id, start, tokens, ids in pieces:
            rows.append((doc_id, start, len(ids) // 4, tokens, number, offset, ids))
            offset += len(ids) // 4
        return rows

    def rest(self) -> Iterator[list[tuple]]:
        """Close what is open: full sequences of mixed classes, then powers of two."""
        pieces = [piece for per_bin in sorted(self.open) for piece in self.open[per_bin]]
        left = sum(len(p[3]) // 4 for p in pieces)
        self.open = {}
        pieces.reverse()
        while left:
            size = self.capacity if left >= self.capacity else 1 << left.bit_length() - 1
            left -= size
            taken = []
            while size:
                doc_id, start, tokens, ids = pieces.pop()
                if len(ids) // 4 > size:
                    pieces.append((doc_id, start + size, tokens, ids[4 * size :]))
                    ids = ids[: 4 * size]
                taken.append((doc_id, start, tokens, ids))
                size -= len(ids) // 4
            yield self._sequence(taken)


def _packed(capacity: int, waste: float, tokenizer: str | None):
    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = worker_tokenizer(tokenizer, *SCAN_BOUNDS), END_ID.to_bytes(4, "little")
        classes = Classes(capacity, TaskContext.get().partitionId() << PART_BITS)
        rows: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(at, TEXTS_AT_ONCE)
                for doc_id, coded in zip(some.column(0).to_pylist(), words.encode_all(some.column(1).to_pylist())):
                    ids, start = coded + end, 0
                    tokens = len(ids) // 4
                    for length in lengths_of(tokens, capacity, waste):
                        rows += classes.put((doc_id, start, tokens, ids[4 * start : 4 * (start + length)]))
                        start += length
                    if len(rows) >= PIECES_AT_ONCE:
                        yield table(rows)
                        rows = []
        for sequence in classes.rest():
            rows += sequence
        if rows:
            yield table(rows)

    return run


def pack_harmonic(docs: DataFrame, capacity: int = CAPACITY, waste: float = WASTE, tokenizer: str | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, doc_tokens, sequence_id, offset and its ``ids``, four bytes each."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(_packed(capacity, waste, tokenizer), PIECE_SCHEMA)


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad: int = 0) -> DataFrame:
    """Per sequence its ``ids``, padded unless it ends at a power of two, with doc_ids and starts of its pieces.

    A sequence is at most ``capacity`` tokens, which bounds what is collected for a group.
    """
    piece = F.struct("offset", "doc_id", "start", "length", "ids")
    held = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda ids, p: F.concat(ids, p["ids"]))
    tokens = F.aggregate("p", F.lit(0).cast("long"), lambda n, p: n + p["length"])
    one = F.lit(pad.to_bytes(4, "little"))
    exact = F.bit_count("n_tokens") == 1
    missing = F.when(exact, 0).otherwise(F.lit(capacity) - F.col("n_tokens")).cast("int")
    filler = F.unhex(F.repeat(F.hex(one), missing))
    return held.select("sequence_id", tokens.alias("n_tokens"), joined.alias("ids"), "p").select(
        "sequence_id", "n_tokens", F.concat("ids", filler).alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts")
    )


def piece_digests(docs: DataFrame, **options) -> DataFrame:
    """The pieces with ``ids_crc32`` in place of their ids."""
    return pack_harmonic(docs, **options).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
