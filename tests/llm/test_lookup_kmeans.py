import hashlib
import math
import random

import numpy as np
import pytest

from flagframe.llm import lookup_kmeans as km


def brute(rows, clusters, rounds, scale, dimension):
    kept = [
        (i, [math.floor(scale * float(x)) if abs(x) < 1 << 53 else int(x) * scale for x in v])
        for i, v in rows
        if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)
    ]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in first[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        mine = {}
        for _, v in kept:
            mine.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(mine[n]) for x in zip(*mine[n])] if n in mine else c for n, c in enumerate(centroids)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    total, per = sum(d for *_, d in out), {}
    for _, n, d in out:
        per[n] = per.get(n, 0) + d

    def fit(x):
        return x if x < 1 << 63 else None

    def sha(n):
        return hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()

    return sorted(((i, n, fit(d), fit(per[n]), fit(total), sha(n)) for i, n, d in out), key=repr)


def run(spark, rows, dimension, clusters=4, rounds=3):
    table = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance string")
    out = km.clustered(table.repartition(3), clusters=clusters, rounds=rounds, dimension=dimension, scale=64)
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_distances_equal_direct_ones():
    rng = np.random.default_rng(3)
    vectors, centroids = rng.integers(-90, 90, (500, 64)), rng.integers(-90, 90, (16, 64))
    direct = ((vectors[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (km.distances(vectors, centroids) == direct).all()
    wide = vectors * (1 << 40)
    assert km.distances(wide, centroids)[0, 0] == sum((int(a) - int(b)) ** 2 for a, b in zip(wide[0], centroids[0]))


def test_integers_are_exact():
    values = np.array([[-0.001, 0.999, 1.5]])
    assert km.integers(values, 64).tolist() == [[-1, 63, 96]]
    assert km.integers(np.array([[1e300, -0.5]]), 64).tolist() == [[int(1e300) * 64, -32]]
    assert km.integers(np.array([[1.7e308, 0.5]]), 64).tolist() == [[int(1.7e308) * 64, 32]]


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_equals_brute_force(spark, spread):
    rng = random.Random(5)
    rows = [(i, [rng.choice((-1, 1)) + spread * rng.gauss(0, 1) for _ in range(5)]) for i in range(150)]
    assert run(spark, rows, 5, clusters=7) == brute(rows, 7, 3, 64, 5)


def test_cases(spark):
    rows = [
        (1, [0.5, 0.5]), (1, [0.5, 0.5]), (1, [-0.5, 0.25]), (None, [0.1, 0.1]), (2, None), (3, [0.5]), (4, [0.5, None]),
        (5, [float("nan"), 0.0]), (6, [float("inf"), 0.0]), (7, [0.0, 0.0, 0.0]), (8, [0.5, 0.5]), (9, [-0.0, 0.0]), (10, []),
    ]
    assert run(spark, rows, 2) == brute(rows, 4, 3, 64, 2)
    assert run(spark, rows, 2, clusters=50) == brute(rows, 50, 3, 64, 2)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(20)]
    assert run(spark, rows, 2) == brute(rows, 4, 3, 64, 2)


def test_huge_components_stay_exact(spark):
    rows = [(i, [float(10**(i % 5 * 6)) * (-1) ** i, 0.5 * i]) for i in range(40)] + [(99, [1e300, -1e300])]
    found = run(spark, rows, 2)
    assert found == brute(rows, 4, 3, 64, 2)
    assert any(r[2] is None for r in found) or found[0][4] is None


def test_empty(spark):
    assert run(spark, [], 2) == []
    assert run(spark, [(1, None)], 2) == []
