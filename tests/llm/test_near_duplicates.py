import random

import pytest
from brute import near_components

from flagframe.llm import jaccard


def rows_of(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_matches_brute_force_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    expected = near_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert rows_of(jaccard.near_duplicates(docs)) == expected
    assert sum(c != d for d, _, c in expected) > 50


@pytest.mark.parametrize("seed", [1, 2])
def test_edited_copies_around_the_threshold(docs_of, seed):
    """Chains, edits of one text and texts of different sizes, many of them close to the threshold."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(6):
        text = [rng.choice(words) for _ in range(rng.choice([12, 60, 150]))]
        for _ in range(25):
            copy = text[:]
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(3)] = [rng.choice(words) for _ in range(rng.randrange(3))]
            rows.append((len(rows), " ".join(copy)))
            if rng.random() < 0.3:
                text = copy
    rng.shuffle(rows)
    assert rows_of(jaccard.near_duplicates(docs_of(rows))) == near_components(rows)


def test_edges(docs_of):
    long = " ".join(f"a{i}" for i in range(20_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO\n"), (6, "one two three"), (7, long), (8, long + " end"), (9, "Été été"),
        (10, "été été"), (4, "One two"), (11, "one two three four five six"), (12, "x y"), (13, "x y"),
    ]
    assert rows_of(jaccard.near_duplicates(docs_of(rows))) == near_components(rows)
    assert jaccard.near_duplicates(docs_of([])).count() == 0


def test_one_of_each_keeps_the_smallest_id(docs_of):
    text = " ".join(f"b{i}" for i in range(60))
    kept = jaccard.one_of_each(docs_of([(5, text), (3, text + " more"), (9, "other words"), (10, None), (11, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 9, 10, 11] and kept.columns[-1] == "score"


def test_one_of_each_with_repeated_and_null_ids(docs_of):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "bcd")
    rows = [
        (5, one), (5, two), (3, one + " more"), (3, three), (7, three + " more"), (7, "words of its own here"),  # one id, two texts
        (8, "equal rows stay but once in all"), (8, "equal rows stay but once in all"), (None, two + " more"), (None, "one two three four five six"),
        (None, "one two three  four five six"), (None, None), (None, ""), (9, None), (9, None),
    ]
    kept = jaccard.one_of_each(docs_of(rows)).collect()
    assert sorted(((r.doc_id or 0), (r.text or "")[:13]) for r in kept) == sorted(
        [(5, two[:13]), (3, one[:13]), (3, three[:13]), (7, "words of its "), (8, "equal rows st"), (0, "one two three"), (0, ""), (0, ""), (9, ""), (9, "")]
    )


def test_rows_may_have_columns_named_as_the_operators_own(docs_of):
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, "alone"), (None, " ".join(words))]
    docs = docs_of(rows).withColumnRenamed("size", "_id").withColumnRenamed("score", "rid")
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_pairs_of_a_leader_with_many_members_are_counted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PARTNERS", 7)
    rng = random.Random(3)
    sets = {node: sorted(rng.sample(range(80), rng.randrange(1, 60))) for node in range(120)}
    pairs = [(0, b) for b in range(1, 120)] + [(a, a + 1) for a in range(1, 20)] + [(5, 9)]
    table = spark.createDataFrame([(n, t) for n, t in sets.items()], "node long, tokens array<long>")
    found = jaccard.overlaps(spark.createDataFrame(pairs, "a long, b long"), table).collect()
    assert sorted((r.a, r.b, r.both) for r in found) == sorted((a, b, len(set(sets[a]) & set(sets[b]))) for a, b in pairs)
    assert jaccard.overlaps(spark.createDataFrame([], "a long, b long"), table).count() == 0
