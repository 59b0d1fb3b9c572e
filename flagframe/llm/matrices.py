"""Operator 8: token matrices by best-fit-decreasing packing.

Texts are tokenised whole, each followed by the end id; documents longer than a matrix row
are split into consecutive segments, so nothing is cut off. Segments are packed in blocks of at
most ``block_tokens`` tokens (one longer document may exceed that by its own
length): longest first, each into the open row with the least room that still
takes it, found in a segment tree over the rooms. A block is packed in the task that
read it, so token ids are never shuffled, and a block's rows are about a thousand
times fewer than its tokens, which makes the unfilled last rows of blocks negligible.

Every row holds ``ids`` (little-endian unsigned, 16 bits where the vocabulary allows, padded
with ``pad``), ``positions`` of the same shape that start again at 0 with every segment,
``cu_seqlens`` (0 and the cumulative segment lengths), and doc_ids and starts of its segments,
from which ``unpacked`` restores every document's ids.

Defined cases: a null or empty text is the end id alone; repeated rows are packed
as often as they occur; an empty table gives no rows. Row numbers depend on how the
table is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagframe.llm.tokens import END_ID, SCAN_BOUNDS, worker_tokenizer

ROW_TOKENS = 4096
BLOCK_TOKENS = 1 << 21
PAD = 0
ROWS_PER_BATCH = 256

_ROWS = pa.schema(
    [
        ("part", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("positions", pa.binary()),
        ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())),
    ]
)
ROW_SCHEMA = (
    "part long, row long, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, starts array<long>"
)


class RoomTree:
    """Open rows by the room left in them; a node counts the rows below it."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return (room, row) with the least room of at least ``length``."""
        count, node = self.count, length + self.size
        if not count[node]:
            # up to the first ancestor with rows to the right, then down its leftmost path
            while node > 1 and not (node & 1 == 0 and count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.size
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows as lists of positions in ``lengths``; every length is in 1..capacity."""
    tree, rows = RoomTree(capacity), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[item])
        if found is None:
            found = capacity, len(rows)
            rows.append([])
        room, row = found
        rows[row].append(item)
        if room > lengths[item]:
            tree.put(room - lengths[item], row)
    return rows


def _packed(capacity: int, block_tokens: int, pad: int, tokenizer: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        words = worker_tokenizer(tokenizer, *SCAN_BOUNDS)
        dtype = np.dtype("<u2" if words.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        held: list[tuple[int, int, np.ndarray]] = []
        total = 0

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal number
            out: list[list] = [[] for _ in _ROWS]
            for row in best_fit_decreasing([len(ids) for _, _, ids in held], capacity):
                segments = [held[i] for i in row]
                sizes = [len(ids) for _, _, ids in segments]
                ids = np.full(capacity, pad, dtype)
                used = sum(sizes)
                ids[:used] = np.concatenate([s[2] for s in segments])
                ends = np.cumsum([0, *sizes])
                positions = np.zeros(capacity, dtype)
                positions[:used] = np.arange(used) - np.repeat(ends[:-1], sizes)
                values = (part, number, used, ids.tobytes(), positions.tobytes(), ends.tolist(), [s[0] for s in segments], [s[1] for s in segments])
                for column, value in zip(out, values):
                    column.append(value)
                number += 1
                if len(out[0]) == ROWS_PER_BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _ROWS)], schema=_ROWS)
                    out = [[] for _ in _ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _ROWS)], schema=_ROWS)

        for batch in batches:
            for doc_id, coded in zip(batch.column(0).to_pylist(), words.encode_all(batch.column(1).to_pylist())):
                ids = np.frombuffer(coded + END_ID.to_bytes(4, "little"), "<u4").astype(dtype)
                held.extend((doc_id, start, ids[start : start + capacity]) for start in range(0, len(ids), capacity))
                total += len(ids)
                if total >= block_tokens:
                    yield from block()
                    held, total = [], 0
        if held:
            yield from block()

    return run


def token_matrices(docs: DataFrame, row_tokens: int = ROW_TOKENS, block_tokens: int = BLOCK_TOKENS, pad: int = PAD, tokenizer: str | None = None) -> DataFrame:
    """All documents as packed rows of ``row_tokens`` ids."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(_packed(row_tokens, block_tokens, pad, tokenizer), ROW_SCHEMA)


def unpacked(rows: DataFrame, row_tokens: int = ROW_TOKENS) -> DataFrame:
    """The segments of packed rows: doc_id, start, ids (binary)."""
    width = F.length("ids") / row_tokens
    places = rows.withColumn("width", width.cast("int")).select(
        "ids", "width", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "starts")).alias("i", "segment")
    )
    start, end = F.get("cu_seqlens", F.col("i")), F.get("cu_seqlens", F.col("i") + 1)
    return places.select(
        F.col("segment.doc_ids").alias("doc_id"),
        F.col("segment.starts").alias("start"),
        F.substring("ids", start * F.col("width") + 1, (end - start) * F.col("width")).alias("ids"),
    )
