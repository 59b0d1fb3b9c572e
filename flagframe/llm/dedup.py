"""Operator 7: exact deduplication by Golomb-coded fingerprint exchange.

Rows are staged once with a row number and the SHA-256 of their normalised text. Then
only fingerprints travel: each sender (a run of rows of one partition) sorts its
fingerprints, drops repeats and sends every owner, a range of the fingerprint space, its
share as Golomb-Rice coded differences. An owner answers each sender with one bit per
fingerprint: some other sender has it too. Rows whose bit is set, or that repeat within
their sender, are suspects. Only their texts are shuffled, and grouping by the
bytes of the normalised text verifies them, so a fingerprint collision costs a
shuffled row and never a wrong answer.

A hot text contributes one fingerprint per sender, and its copies collapse before the
shuffle of the texts, so no task receives the copies themselves.

Defined cases: a null text counts as empty, and empty texts are equal to each other. Of
equal texts the row with the most code points stays, then the smallest doc_id, nulls
last, then the first row as staged, so of repeated rows exactly one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flagframe.session import staged

FINGERPRINT_BITS = 48
SENDER_ROWS = 1 << 16
OWNER_FINGERPRINTS = 1 << 20
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


# --- Golomb-Rice coding of sorted numbers -----------------------------------------------


def rice_encode(values: np.ndarray, span: int) -> bytes:
    """Code strictly ascending integers in [0, span): a header, the unary quotients, the remainders bit by bit."""
    if not len(values):
        return b""
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    k = max(0, int(span // (len(values) + 1)).bit_length() - 1)
    stops = np.cumsum((gaps >> k) + 1) - 1
    unary = np.zeros(int(stops[-1]) + 1, np.uint8)
    unary[stops] = 1
    planes = [np.packbits((gaps >> bit & 1).astype(np.uint8)).tobytes() for bit in range(k)]
    return b"".join([bytes([k]), np.int64([len(values), len(unary)]).tobytes(), np.packbits(unary).tobytes(), *planes])


def rice_decode(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.int64)
    k = data[0]
    n, length = np.frombuffer(data, np.int64, 2, 1)
    body = np.frombuffer(data, np.uint8, offset=17)
    cut, plane = (length + 7) // 8, (n + 7) // 8
    values = (np.diff(np.flatnonzero(np.unpackbits(body[:cut], count=length)), prepend=-1) - 1) << k
    for bit in range(k):  # one bit of all remainders at a time
        own = np.unpackbits(body[cut + bit * plane : cut + (bit + 1) * plane], count=n).astype(np.int64)
        own <<= bit
        values += own
    values += 1
    return np.cumsum(values, out=values) - 1


# --- the exchange -------------------------------------------------------------------------


def _messages(owners: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= SENDER_ROWS:
                yield message(held)
                held, rows = [], 0
        if rows:
            yield message(held)

    def message(held):
        table = pa.Table.from_batches(held)
        rid, finger = (table.column(c).to_numpy() for c in ("rid", "finger"))
        order = np.lexsort((rid, finger))
        rid, finger = rid[order], finger[order]
        values, starts, counts = np.unique(finger, return_index=True, return_counts=True)
        owner = values // width
        out = {c: [] for c in ("sender", "owner", "code", "rids", "counts")}
        for o in np.unique(owner):
            a, b = np.searchsorted(owner, [o, o + 1])
            end = starts[b - 1] + counts[b - 1]
            out["sender"].append(int(rid.min()))
            out["owner"].append(int(o))
            out["code"].append(rice_encode(values[a:b] - o * width, width))
            out["rids"].append(rid[starts[a] : end].tobytes())
            out["counts"].append(counts[a:b].astype(np.int32).tobytes())
        return pa.RecordBatch.from_pydict(
            out, pa.schema([("sender", pa.int64()), ("owner", pa.int64()), ("code", pa.binary()), ("rids", pa.binary()), ("counts", pa.binary())])
        )

    return run


def members(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``values`` are among the sorted ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _answers(group: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmaps: for each sender, which of its fingerprints another sender has too."""
    lists = [rice_decode(code) for code in group.code]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    shared = values[counts > 1]
    bits = [np.packbits(members(one, shared)).tobytes() for one in lists]
    return pd.DataFrame({"sender": group.sender, "owner": group.owner, "bits": bits})


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.empty(0, np.int64)]
        for rids, counts, bits in zip(*(batch.column(c).to_pylist() for c in ("rids", "counts", "bits"))):
            n = np.frombuffer(counts, np.int32)
            marked = (n > 1) | np.unpackbits(np.frombuffer(bits, np.uint8), count=len(n)).astype(bool)
            found.append(np.frombuffer(rids, np.int64)[np.repeat(marked, n)])
        yield pa.RecordBatch.from_pydict({"rid": pa.array(np.concatenate(found))})


def suspects(rows: DataFrame, owners: int) -> DataFrame:
    """Numbers of the rows of ``rows`` (rid, finger) whose fingerprint occurs more than once."""
    width = -(-(1 << FINGERPRINT_BITS) // owners)
    messages = staged(
        rows.mapInArrow(_messages(owners, width), "sender long, owner long, code binary, rids binary, counts binary"), "dedup-messages"
    )
    answers = (
        messages.select("sender", "owner", "code").groupBy("owner").applyInPandas(_answers, "sender long, owner long, bits binary")
    )
    heard = messages.select("sender", "owner", "rids", "counts").join(answers, ["sender", "owner"])
    return staged(heard.mapInArrow(_suspects, "rid long"), "dedup-suspects")


def _staged_rows(docs: DataFrame, carry: bool) -> DataFrame:
    """All rows once, numbered; a number belongs to the same row for every later reader."""
    norm = normalised(F.col("text").cast("string"))
    columns = [
        F.monotonically_increasing_id().alias("rid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("length"),
        F.sha2(norm.cast("binary"), 256).alias("text_sha256"),
    ]
    body = F.struct(*[docs[c] for c in docs.columns]).alias("row") if carry else norm.alias("norm")
    return staged(docs.select(*columns, body), "dedup-rows")


def _decided(rows: DataFrame, norm: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with a unique text, suspects with their verified group)."""
    finger = F.conv(F.substring("text_sha256", 1, FINGERPRINT_BITS // 4), 16, 10).cast("long")
    owners = max(1, rows.count() // OWNER_FINGERPRINTS)
    marked = suspects(rows.select("rid", finger.alias("finger")), owners)
    single = rows.join(marked, "rid", "left_anti")
    suspect = rows.join(marked, "rid", "left_semi")
    rank = F.struct("length", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("first"), (-F.col("rid")).alias("row"))
    classes = suspect.groupBy("text_sha256", norm.alias("bytes")).agg(F.max(rank).alias("best"), F.count("*").alias("group_size"))
    # two texts of one digest, should they ever occur, are told apart by their bytes
    several = classes.groupBy(F.col("text_sha256").alias("digest")).count().where("count > 1")
    twins = staged(
        classes.join(several, F.col("text_sha256") == F.col("digest"), "left").select(
            F.col("text_sha256").alias("twin"), "best", "group_size", F.when(F.col("count") > 1, F.col("bytes")).alias("bytes")
        ),
        "dedup-classes",
    )
    same = (F.col("text_sha256") == F.col("twin")) & (F.col("bytes").isNull() | (F.col("bytes") == norm))
    return single, suspect.join(twins, same)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = _staged_rows(docs, carry=False)
    single, grouped = _decided(rows, F.col("norm"))
    best = F.col("best")
    alone = single.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    return alone.unionAll(
        grouped.select("doc_id", (-best["first"]).alias("keep_id"), "group_size", (-best["row"] == F.col("rid")).alias("kept"), "text_sha256")
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, of which one stays per group of equal texts."""
    rows = _staged_rows(docs, carry=True)
    single, grouped = _decided(rows, normalised(F.col("row.text").cast("string")))
    kept = grouped.where(-F.col("best")["row"] == F.col("rid"))
    return single.select("row.*").unionAll(kept.select("row.*"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS length, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w AS place
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY length DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""
