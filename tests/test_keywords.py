"""Keyword tables (C6) against brute force."""

import random

from flagframe.operators import textscan

TEXTS = [
    (1, "Authentication and authorisation; AUTHENTIC auth"), (2, ""), (3, None), (4, "a"), (5, "ab"), (6, "hahahaha ha"),
    (7, "\U0001f600abc \U0001f600\U0001f600 é été ÉTÉ"), (8, "line one\nline two\nabc"), (9, "x" * 3000 + "authentic"), (9, "?abc"),
]
WORDS = ["auth", "authentic", "authentication", "a", "ab", "abc", "?abc", "\U0001f600", "\U0001f600abc", "été", "haha", "one\nline", "xx", "", None, "nowhere"]


def expected(texts, words):
    out = {}
    for key, text in texts:
        low = (text or "").lower()
        for word in filter(None, words):
            n = sum(low.startswith(word, i) for i in range(len(low)))
            if n:
                out[key, word] = out.get((key, word), 0) + n
    return sorted((k, w, n) for (k, w), n in out.items())


def test_matches_equal_brute_force(spark):
    texts = spark.createDataFrame(TEXTS, "id long, text string")
    words = spark.createDataFrame([(w,) for w in WORDS], "keyword string")
    for gram in (1, 3, 5):
        got = textscan.keyword_matches(texts, ["id"], "text", words, gram).collect()
        assert sorted(tuple(r) for r in got) == expected(TEXTS, WORDS)


def test_keywords_that_begin_alike_are_not_compared_one_by_one(spark):
    rng = random.Random(3)
    words = [f"prefix{i}" for i in range(300)] + [f"prefix of {i}" for i in range(300)] + ["\U00010428b_", "ix1 "]
    texts = [(i % 190, " ".join(rng.choice(words) + rng.choice(["", "0", "x", "-", "\U00010428b_c"]) for _ in range(30))) for i in range(200)]
    texts += [(500, "prefix" * 500), (501, "PREFIX7\x00prefix\u0301 prefix 77")]
    got = textscan.keyword_matches(spark.createDataFrame(texts, "id long, text string"), ["id"], "text", spark.createDataFrame([(w,) for w in words], "keyword string"))
    assert sorted(map(tuple, got.collect())) == expected(texts, words)
    # joins are on equal texts alone: nothing is filtered out of what they make
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert joins and not any("StartsWith" in line or "Contains" in line for line in joins)


def test_first_keyword_of_many_that_begin_alike(spark):
    rng = random.Random(4)
    words = [f"prefix{i}" for i in range(200)] + [f"prefix-{i}" for i in range(200)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(9)))) for i in range(100)]
    table = spark.createDataFrame([(w, 1000 - i) for i, w in enumerate(words)], "keyword string, rank long")
    found = textscan.keyword_matches(spark.createDataFrame(texts, "id long, text string"), ["id"], "text", table)
    first = textscan.first_of_table(found, ["id"], table)
    by_id = {}
    for key, word, _ in expected(texts, words):
        by_id.setdefault(key, []).append((1000 - words.index(word), word))
    assert {r.id: (r.keyword, r.n_keywords) for r in first.collect()} == {k: (min(v)[1], len(v)) for k, v in by_id.items()}
    assert "StartsWith" not in first._jdf.queryExecution().optimizedPlan().toString()


def test_no_keywords_no_texts_and_first_of_table(spark):
    texts = spark.createDataFrame(TEXTS, "id long, text string")
    words = spark.createDataFrame([(w, len(w or "") * 100 + i) for i, w in enumerate(WORDS)], "keyword string, rank long")
    assert textscan.keyword_matches(texts, ["id"], "text", words.limit(0)).count() == 0
    assert textscan.keyword_matches(texts.limit(0), ["id"], "text", words).count() == 0
    got = textscan.first_of_table(textscan.keyword_matches(texts, ["id"], "text", words), ["id"], words).collect()
    found = {}
    for key, word, _ in expected(TEXTS, WORDS):
        found.setdefault(key, []).append((len(word) * 100 + WORDS.index(word), word))
    assert {r.id: (r.keyword, r.n_keywords) for r in got} == {k: (min(v)[1], len(v)) for k, v in found.items()}


def test_counts_with_more_keywords_than_a_mask_holds(spark):
    rng = random.Random(1)
    words = [f"k{i}z" for i in range(130)]
    texts = [(i, " ".join(rng.sample(words, rng.randrange(4)))) for i in range(200)] + [(-1, None)]
    got = textscan.keyword_counts(spark.createDataFrame(texts, "id long, text string"), "text", words).collect()
    has = {w: sum(w in (t or "") for _, t in texts) for w in words}
    first = {w: sum(next((v for v in words if v in (t or "")), None) == w for _, t in texts) for w in words}
    assert {r.keyword: (r.rows_with, r.rows_first) for r in got} == {w: (has[w], first[w]) for w in words}


def test_first_keyword_by_rank_joins_no_matches_and_cuts_texts_once(spark):
    rng = random.Random(5)
    words = [f"prefix{i}" for i in range(200)] + [f"a prefix-{i}" for i in range(200)]
    texts = [(i % 90 or None, " ".join(rng.choice(words) for _ in range(rng.randrange(9)))) for i in range(100)]
    ranks = {w: 1000 - i for i, w in enumerate(words)}
    table = spark.createDataFrame([*ranks.items(), ("", 1), (None, 2)], "keyword string, rank long")
    frame = spark.createDataFrame(texts, "id long, text string")
    found = textscan.keyword_matches(frame, ["id"], "text", table, name="rank")
    assert found.columns == ["id", "rank", "occurrences"]
    whole = expected([(key or -1, text) for key, text in texts], words)
    assert sorted((r.id or -1, r.rank, r.occurrences) for r in found.collect()) == sorted((k, ranks[w], n) for k, w, n in whole)
    first = textscan.first_of_table(found, ["id"], table)
    by_id = {}
    for key, word, _ in whole:
        by_id.setdefault(key, []).append((ranks[word], word))
    assert {r.id or -1: (r.keyword, r.n_keywords) for r in first.collect()} == {k: (min(v)[1], len(v)) for k, v in by_id.items()}

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    # the one join is of the best rank of each row
    assert plan(first).count("Join ") == plan(found).count("Join ") + 1
    whole_words = textscan.keyword_matches(frame, ["id"], "text", table.where("keyword LIKE 'prefix%'"), name="rank")
    assert "regexp_extract_all(lower" not in plan(whole_words) and "_text" not in plan(whole_words)
