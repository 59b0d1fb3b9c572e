import zlib
from collections import defaultdict

import numpy as np
import pytest

from flagframe.llm import harmonic, queries
from flagframe.llm.tokens import WordTokenizer


def test_cuts_cover_and_fit():
    for rest in range(2048):
        lengths = harmonic.cuts(rest, 2048, 0.03)
        assert sum(lengths) == rest and all(lengths)
        for length in lengths:
            per_bin = 2048 // length
            assert 2048 // (per_bin + 1) < length <= 2048 // per_bin
            assert 2048 - per_bin * length <= 0.03 * 2048
    assert harmonic.lengths_of(5000, 2048) == (2048, 2048, *harmonic.cuts(904, 2048, 0.03))


def test_class_sequences_take_a_fixed_count():
    classes, closed = harmonic.Classes(64), []
    for n in range(1, 400):
        length = 1 + n * 7 % 64
        rows = classes.put((n, 0, length, b"\0" * 4 * length))
        if rows:
            closed.append(rows)
    for rows in closed:
        count = {64 // r[2] for r in rows}
        assert len(count) == 1 and len(rows) == count.pop()
    rest = list(classes.rest())
    sizes = [sum(r[2] for r in rows) for rows in rest]
    full = sum(s == 64 for s in sizes)
    assert sizes[:full] == [64] * full and sum(sizes[full:]) < 64 and all(s & (s - 1) == 0 for s in sizes)


def check(pieces, texts, capacity):
    """Every id lies in one piece, sequences are gapless and within the capacity; returns the share of padding."""
    coded = WordTokenizer()
    ids = {doc: coded.encode(text) + (1).to_bytes(4, "little") for doc, text in texts}
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        of_doc[p.doc_id].append(p)
        of_sequence[p.sequence_id].append(p)
        assert p.length == len(p.ids) // 4 > 0
    assert set(of_doc) == set(ids)
    for doc, mine in of_doc.items():
        mine.sort(key=lambda p: p.start)
        assert b"".join(p.ids for p in mine) == ids[doc]
        assert [p.start for p in mine] == np.cumsum([0, *[p.length for p in mine]])[:-1].tolist()
        assert {p.doc_tokens for p in mine} == {len(ids[doc]) // 4}
    padding = 0
    for mine in of_sequence.values():
        mine.sort(key=lambda p: p.offset)
        ends = np.cumsum([0, *[p.length for p in mine]])
        assert [p.offset for p in mine] == ends[:-1].tolist() and ends[-1] <= capacity
        padding += 0 if ends[-1] & (ends[-1] - 1) == 0 else capacity - ends[-1]
    return padding / sum(len(x) // 4 for x in ids.values())


def test_round_trip_of_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = harmonic.pack_harmonic(docs.repartition(3)).collect()
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert check(pieces, texts, 2048) < 0.01
    assert len(pieces) < 3 * len(texts)


@pytest.mark.parametrize("capacity", [16, 100])
def test_cases(docs_of, capacity):
    texts = [(1, None), (2, ""), (3, "a b c"), (4, "word " * 5000), (5, "a b c"), (6, "tie tie"), (None, "no id"), (8, " \t\n")]
    pieces = harmonic.pack_harmonic(docs_of(texts), capacity=capacity, waste=0.1).collect()
    check(pieces, texts, capacity)


def test_repeated_rows_and_empty_table(docs_of):
    pieces = harmonic.pack_harmonic(docs_of([(1, "a b c")] * 5)).collect()
    assert sum(p.length for p in pieces) == 20
    assert harmonic.pack_harmonic(docs_of([])).collect() == []


def test_sequences_hold_the_ids(docs_of):
    texts = [(i, f"word {i} " * (i % 40)) for i in range(200)]
    pieces = harmonic.pack_harmonic(docs_of(texts).coalesce(1)).cache()
    rows = harmonic.sequences(pieces, pad=7).collect()
    by = defaultdict(list)
    for p in pieces.collect():
        by[p.sequence_id].append(p)
    assert {r.sequence_id for r in rows} == set(by)
    for r in rows:
        mine = sorted(by[r.sequence_id], key=lambda p: p.offset)
        joined = b"".join(p.ids for p in mine)
        exact = r.n_tokens & (r.n_tokens - 1) == 0
        assert bytes(r.ids) == joined + (b"" if exact else (7).to_bytes(4, "little") * (2048 - r.n_tokens))
        assert list(r.doc_ids) == [p.doc_id for p in mine] and list(r.starts) == [p.start for p in mine]


def test_query_columns(spark):
    out = queries.op13_harmonic_packing(spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes) == {
        "doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"
    }
    plain = {(p.doc_id, p.start): p for p in harmonic.pack_harmonic(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    for r in out.collect():
        assert r.ids_crc32 == zlib.crc32(plain[r.doc_id, r.start].ids) and r.length == plain[r.doc_id, r.start].length
