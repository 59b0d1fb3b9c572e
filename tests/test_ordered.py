import random

from pyspark.sql import functions as F

from flagframe.operators.ordered import carry_last, chunked, number_rows


def skewed_rows(n=600, seed=5):
    """A third of the rows under one key, another third under NULL."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = [1, None, rng.randrange(2, 30)][i % 3]
        rows.append((key, rng.randrange(200), i, rng.choice(["a", "b", None, None])))
    return rows


def test_carry_last(spark):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "k int, t int, id int, v string").repartition(7)
    got = carry_last(df, ["k"], ["t", "id"], {"prev": F.col("v")})
    expected, last = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        expected[i] = last.get(k)
        if v is not None:
            last[k] = v
    assert {r.id: r.prev for r in got.collect()} == expected


def test_number_rows(spark):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "k int, t int, id int, v string").repartition(7)
    got = number_rows(df, ["k"], ["t", "id"], "n", "size")
    expected, seen = {}, {}
    for k, t, i, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        seen[k] = expected[i] = seen.get(k, 0) + 1
    assert {r.id: r.n for r in got.collect()} == expected
    assert {r.k: r["size"] for r in got.collect()} == seen


def test_one_key_of_all_rows_with_a_text_order(spark):
    names = [f"{i * 7919 % 1000:04d}" for i in range(1000)]
    df = spark.createDataFrame([("a", n, i) for i, n in enumerate(names)], "k string, s string, id int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one partition
    try:
        sizes = [r["count"] for r in chunked(df, ["k"], ["s"]).groupBy("_chunk").count().collect()]
        got = number_rows(df, ["k"], ["s"], "n", "size").collect()
        before = {r.s: r.prev for r in carry_last(df, ["k"], ["s"], {"prev": F.col("id")}).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 600
    assert {r.s: r.n for r in got} == {f"{i:04d}": i + 1 for i in range(1000)} and {r["size"] for r in got} == {1000}
    place = {n: i for i, n in enumerate(names)}
    assert before == {f"{i:04d}": place[f"{i - 1:04d}"] if i else None for i in range(1000)}


def test_one_position_for_all_rows(spark):
    df = spark.createDataFrame([(1, 5, i) for i in range(20)], "k int, t int, id int")
    got = number_rows(df, ["k"], ["t", "id"], "n")
    assert {r.id: r.n for r in got.collect()} == {i: i + 1 for i in range(20)}


def test_null_positions_come_first(spark):
    df = spark.createDataFrame([(1, None if i < 4 else i, i) for i in range(12)], "k int, t int, id int")
    got = number_rows(df, ["k"], ["t", "id"], "n")
    assert {r.id: r.n for r in got.collect()} == {i: i + 1 for i in range(12)}
