"""Search, mixing, archives, deduplication and packing against plain versions, and their edges."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flagframe.llm import binpack, dedup, matrices, mixing, topk, warc
from flagframe.llm.tokens import WordTokenizer

# --- op 1 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block_rows,group_queries", [(1 << 14, 1 << 12), (90, 3)])
def test_topk_matches_brute_force(spark, block_rows, group_queries):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=rng.choice([6, 8])).round(1)]) for i in range(400)]
    rows += [(400, None), (450, [1.0, None]), (500, [float("nan")]), (550, [float("inf")]), (600, []), (7, [1.0] * 8), (50, rows[50][1]), (None, [1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    found = topk.top_k(df, F.col("vec_id") % 50 == 0, block_rows=block_rows, group_queries=group_queries).collect()
    sound = [(i, np.pad(np.floor(256 * np.array(v)), (0, 8 - len(v)))) for i, v in rows if v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for q, v in {(i, tuple(v)): (i, v) for i, v in sound if i % 50 == 0}.values():
        best = sorted(((-int(v @ w), j) for j, w in sound if j != q))[:5]
        expected += [(q, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == sorted(expected)


def test_topk_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty, F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(one, F.col("vec_id") % 50 == 0).count() == 0


def test_processing_stops_on_proof():
    """A block with a clear answer is left before all segments are processed, with the right rows."""
    rng = np.random.default_rng(1)
    vectors = rng.integers(-20, 20, (4000, 8))
    vectors[7] = 120
    block = topk.Block(np.arange(4000), vectors, 8)
    query = np.full(8, 100)
    assert len(block.possible(query, -1, 1)) < 100 and block.search(query, -1, 1)[0][0] == 7


# --- op 5 ---------------------------------------------------------------------------------------------


def test_mix_edges(docs_of):
    rows = [(1, "a b c", None, "s"), (2, None, None, "s"), (3, "x " * 30_000, None, "t"), (4, "", None, None), (5, "u v", None, None), (5, "u v", None, None), (None, "w", None, "u")]
    found = mixing.mix_sizes(docs_of(rows)).collect()
    assert len(found) == 7 and all(r.taken in (0, r.size, 2 * r.size) for r in found)
    sizes, targets = Counter(), {}
    for r in found:
        sizes[r.source] += r.size
        targets[r.source] = r.target
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(targets[s] <= 2 * sizes[s] + 1e-6 for s in sizes)
    assert mixing.mix_sizes(docs_of([])).count() == 0 and mixing.mixed(docs_of([])).count() == 0


def test_mix_comes_near_its_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    by = defaultdict(list)
    for r in mixing.mix_sizes(docs).collect():
        by[r.source].append(r)
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r.size for r in rows)
    taken = {r.doc_id: r.taken // r.size for rows in by.values() for r in rows if r.taken}
    assert Counter(r.doc_id for r in mixing.mixed(docs).select("doc_id").collect()) == taken


# --- op 6 ---------------------------------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    big, tricky = "é" * 70_001 + "x\r\n\r\n", "a WARC/1.1\r\nWARC-Type: x\r\n\r\n" * 40 + "WARC/1.1"
    pages = [(1, "http://x", big), (2, None, None), (3, "u\r\nv WARC/1.1", ""), (4, "u", big), (0, "u", tricky), (5, "u", tricky), (5, "u", tricky), (None, "u", "only"), (None, "u", big)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload_bytes string")
    rows = warc.round_trip(df, str(tmp_path / "warc"), chunk_bytes=1000, compression="none").collect()
    expected = Counter()
    for page_id, _, html in pages:
        same = [p for p, _, h in pages if (h or "") == (html or "") and p is not None]
        first = min(same) if same else None
        data = (html or "").encode()
        revisit = page_id != first
        expected[page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == expected
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "warc").glob("part*")))
    assert raw.count(b"WARC/1.1\r\n") == raw.count(b"Content-Length") > 150 and raw.endswith(b"\r\n\r\n")
    assert warc.round_trip(df.limit(0)).count() == 0


# --- op 7 ---------------------------------------------------------------------------------------------


def test_rice_round_trip():
    rng = np.random.default_rng(3)
    for n, span in [(1, 1), (1, 1 << 48), (5, 5), (1000, 1 << 20), (3000, 1 << 48), (17, 1 << 62)]:
        values = np.unique(rng.integers(0, span, n, dtype=np.int64))
        assert (dedup.rice_decode(dedup.rice_encode(values, span)) == values).all()
    assert len(dedup.rice_decode(dedup.rice_encode(np.empty(0, np.int64), 9))) == 0


def test_exact_duplicates_edges(docs_of, monkeypatch):
    monkeypatch.setattr(dedup, "FINGERPRINT_BITS", 4)  # nearly every row a suspect: bytes decide
    rows = [(1, None), (2, ""), (3, " \n"), (9, "a b"), (4, "ab"), (5, "a  b"), (6, "A b"), (7, "a b"), (8, "x" * 100_000), (8, "x" * 100_000), (None, "ab"), (None, "q")]
    found = dedup.exact_duplicates(docs_of(rows)).collect()
    by = {(r.doc_id, r.text_sha256): r for r in found}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in found if r.text_sha256 == sha("")} == {1: (3, 3, False), 2: (3, 3, False), 3: (3, 3, True)}
    assert by[9, sha("ab")].keep_id == 5 and by[5, sha("ab")].kept and by[None, sha("ab")].group_size == 4
    assert by[7, sha("a b")].group_size == 1
    assert sum(r.kept for r in found if r.doc_id == 8) == 1
    kept = dedup.without_copies(docs_of(rows))
    assert Counter(r.doc_id for r in kept.collect()) == {3: 1, 5: 1, 6: 1, 7: 1, 8: 1, None: 1} and "score" in kept.columns
    assert dedup.exact_duplicates(docs_of([])).count() == 0


# --- op 8 and 10 ----------------------------------------------------------------------------------------


def whole_ids(text):
    return [*WordTokenizer().tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


ODD = ["Don't STOP now", "ΣΑΣ ς", "é ́a", "<|endoftext|>x", "a b\x1cc\x0bd", "日本語 テスト 123", "'ll we'll", "", None, "İstanbul ﬁ"]


def test_words_give_the_ids_of_the_text():
    words = WordTokenizer()
    for text in ODD:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == whole_ids(text)[:-1], text


def check_pieces(rows, texts, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for doc_id, text in texts.items():
        ids, pieces = np.array(whole_ids(text), "<u4"), sorted(by[doc_id], key=lambda r: r.piece)
        assert [p.start for p in pieces] == list(range(0, len(ids), capacity))
        assert [p.length for p in pieces] == [min(capacity, len(ids) - p.start) for p in pieces]
        assert [p.ids_crc32 for p in pieces] == [zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces]
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_is_lossless_and_tight(docs_of):
    rng = random.Random(8)
    texts = {i: " ".join(rng.choice(["word", "bins", "zebra"]) for _ in range(rng.randrange(90))) for i in range(300)} | dict(enumerate(ODD, 1000))
    texts[5000] = "long " * 9_000
    rows = binpack.pack(docs_of(list(texts.items())), capacity=128).collect()
    used = check_pieces(rows, texts, 128)
    assert used <= -(-sum(r.length for r in rows) // 128) + 1
    assert binpack.pack(docs_of([])).count() == 0
    twice = binpack.pack(docs_of([(1, "a b"), (1, "a b"), (None, "c")])).collect()
    assert sorted(r.offset for r in twice) == [0, 2, 5] or len({r.sequence_id for r in twice}) == 1


def test_fullest_is_the_best_subset():
    rng = np.random.default_rng(6)
    for _ in range(200):
        counts = np.zeros(41, np.int64)
        counts[rng.integers(1, 41, 6)] = rng.integers(1, 4, 6)
        room = int(rng.integers(0, 60))
        lengths = [int(x) for x in np.flatnonzero(counts)[::-1]]
        chosen = binpack.fullest(counts, lengths, room)
        assert all(0 < k <= counts[n] for n, k in chosen)
        sums = {0}
        for n in lengths:
            for _ in range(counts[n]):
                sums |= {s + n for s in sums}
        assert sum(n * k for n, k in chosen) == max(s for s in sums if s <= room)


def test_best_fit_decreasing_matches_a_plain_search():
    rng = random.Random(9)
    for _ in range(200):
        lengths = [rng.randrange(1, 51) for _ in range(rng.randrange(1, 60))]
        rooms = []
        for n in sorted(lengths, reverse=True):
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else 50) - n)
        rows = matrices.best_fit_decreasing(lengths, 50)
        assert sorted(50 - sum(lengths[i] for i in row) for row in rows) == sorted(rooms)
        assert sorted(i for row in rows for i in row) == list(range(len(lengths)))


def test_matrices_restore_every_document(docs_of):
    texts = dict(enumerate(["one two three " * n for n in range(40)])) | dict(enumerate(ODD, 100)) | {999: "tail " * 700}
    rows = matrices.token_matrices(docs_of(list(texts.items())), row_tokens=64, block_tokens=500).cache()
    for r in rows.collect():
        assert len(r.ids) == len(r.positions) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 64
        sizes = np.diff(r.cu_seqlens)
        assert np.frombuffer(r.positions, "<u2")[: r.n_tokens].tolist() == [i for n in sizes for i in range(n)]
    found = defaultdict(dict)
    for r in matrices.unpacked(rows, 64).collect():
        found[r.doc_id][r.start] = np.frombuffer(r.ids, "<u2").tolist()
    assert {d: sum((x for _, x in sorted(parts.items())), []) for d, parts in found.items()} == {d: whole_ids(t) for d, t in texts.items()}
    assert matrices.token_matrices(docs_of([])).count() == 0


def test_scores_past_a_long_raise(spark):
    rows = spark.createDataFrame([(0, [1e18, 1.0]), (1, [-1e18, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="do not fit a long"):
        topk.top_k(rows, F.col("vec_id") % 50 == 0)
    rows = spark.createDataFrame([(0, [4e6, 1.0]), (1, [-4e6, 2.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(rows, F.col("vec_id") % 50 == 0).collect()[0].score == -((256 * 4 * 10**6) ** 2) + 256 * 512
