"""Operator 12: centroid clustering in exact integers, with scalar lookup tables.

A vector component x becomes the integer floor(scale * x). A round reads the vectors in blocks. For
every dimension of a block the occurring integer values are listed once, and the squared difference
of each of them to each centroid is tabulated: a distance is then the sum of one table entry per
dimension, gathered by the value's place in the list. A block of vectors holds few
different values, so most squared differences are computed once for many vectors.

Numbers are 64 bits wide where no sum can pass that, which is tested per block, and Python integers
beyond, so assignments, sums and centroids are exact for all finite components. Sums travel as
decimal text for the same reason: per task and cluster one row, folded in two steps, so a cluster with
most of the vectors costs no more than another. What reaches the driver is the centroids and 16
sums per dimension, whatever the number of vectors.

Defined cases: vectors that are null, of another dimension, or hold a null or non-finite component
take no part; rows with equal vec_id are vectors of their own, and as first centroids
ordered by their components; a null vec_id hashes as the empty text after the seed; with fewer vectors
than clusters there are as many clusters as vectors; an empty table gives no rows; extra
columns are not read. A distance or inertia beyond 63 bits is null, all else stays exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagframe.session import staged

DIMENSION = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = "1"
BLOCK = 2048
FOLD = 512
LONG_MAX = (1 << 63) - 1


# --- vectors and distances ------------------------------------------------------------------


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, as int64 where all fit into 31 bits, else as Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if scaled.size == 0 or np.abs(scaled).max() < 1 << 31:
        return scaled.astype(np.int64)
    # beyond 2^53 a double is an integer itself
    exact = [int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale) for x in values.ravel().tolist()]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(values.shape)


def _fits(vectors: np.ndarray, centroids: np.ndarray) -> bool:
    """Whether a squared distance surely fits into 63 bits."""
    if vectors.dtype == object or centroids.dtype == object:
        return False
    widest = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    return vectors.shape[1] * (2 * widest) ** 2 <= LONG_MAX


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of every vector to every centroid, from one table per dimension."""
    if not _fits(vectors, centroids):
        vectors, centroids = vectors.astype(object), centroids.astype(object)
    total = np.zeros((len(vectors), len(centroids)), vectors.dtype)
    for d in range(vectors.shape[1]):
        occurring, place = np.unique(vectors[:, d], return_inverse=True)
        table = (occurring[:, None] - centroids[None, :, d]) ** 2
        total += table[place]
    return total


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid; ties go to the smaller number."""
    all_ = distances(vectors, centroids)
    cluster = all_.argmin(axis=1)
    return cluster, all_[np.arange(len(all_)), cluster]


def _blocks(batches: Iterator[pa.RecordBatch], dimension: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            some = batch.slice(at, BLOCK)
            values = some.column(1).flatten().to_numpy(zero_copy_only=False)
            yield some, integers(values.reshape(-1, dimension), scale)


def _sums(centroids: np.ndarray, scale: int):
    """Per task and cluster: how many vectors, and the sums of their components as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dimension = centroids.shape
        counts, sums = [0] * k, [[0] * dimension for _ in range(k)]
        for _, vectors in _blocks(batches, dimension, scale):
            cluster, _ = nearest(vectors, centroids)
            for c in np.unique(cluster).tolist():
                mine = vectors[cluster == c]
                counts[c] += len(mine)
                sums[c] = [a + b for a, b in zip(sums[c], mine.sum(axis=0).tolist())]
        found = [c for c in range(k) if counts[c]]
        columns = [found, [counts[c] for c in found], [[str(x) for x in sums[c]] for c in found]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _SUMS.types)], schema=_SUMS)

    return run


_SUMS = pa.schema([("cluster", pa.int32()), ("vectors", pa.int64()), ("sums", pa.list_(pa.string()))])
SUMS_SCHEMA = "cluster int, vectors long, sums array<string>"


def _folded(frame: pd.DataFrame) -> pd.DataFrame:
    sums = [sum(map(int, column)) for column in zip(*frame.sums)]
    return pd.DataFrame({"cluster": [frame.cluster.iloc[0]], "vectors": [int(frame.vectors.sum())], "sums": [[str(x) for x in sums]]})


def cluster_sums(vectors: DataFrame, centroids: np.ndarray, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Vectors and component sums of every non-empty cluster."""
    parts = vectors.mapInArrow(_sums(centroids, scale), SUMS_SCHEMA)
    some = parts.withColumn("_fold", (F.spark_partition_id() / FOLD).cast("int"))
    folded = some.groupBy("cluster", "_fold").applyInPandas(_folded, SUMS_SCHEMA)
    rows = folded.groupBy("cluster").applyInPandas(_folded, SUMS_SCHEMA).collect()  # a row per cluster
    return {r.cluster: (r.vectors, [int(x) for x in r.sums]) for r in rows}


def _centroid_array(rows: list[list[int]]) -> np.ndarray:
    wide = any(abs(x) >= 1 << 31 for row in rows for x in row)
    return np.array(rows, object if wide else np.int64)


# --- operator ---------------------------------------------------------------------------------


def kept_vectors(embeddings: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """(vec_id, x) of the vectors that take part, components as doubles."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return embeddings.select(F.col("vec_id").cast("long"), x.alias("x")).where((F.size("x") == dimension) & ~bad)


def first_centroids(vectors: DataFrame, clusters: int, scale: int, seed: str) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id, in the order of the hashes."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.orderBy(F.sha2(name, 256), "x").limit(clusters).select("x").collect()
    return _centroid_array([integers(np.array(r.x), scale).tolist() for r in rows])


def centroids_after(vectors: DataFrame, centroids: np.ndarray, rounds: int, scale: int) -> np.ndarray:
    """Centroids after ``rounds`` rounds of assignment and update; empty clusters keep theirs."""
    for _ in range(rounds):
        rows = centroids.tolist()
        for c, (n, sums) in cluster_sums(vectors, centroids, scale).items():
            rows[c] = [s // n for s in sums]
        moved = _centroid_array(rows)
        if (moved == centroids).all():
            break  # every later round would find the same
        centroids = moved
    return centroids


def _assigned(centroids: np.ndarray, scale: int):
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, vectors in _blocks(batches, centroids.shape[1], scale):
            cluster, distance = nearest(vectors, centroids)
            if distance.dtype == object:
                distance = [d if d <= LONG_MAX else None for d in distance.tolist()]
            columns = [some.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def assign(vectors: DataFrame, centroids: np.ndarray, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance) of the nearest centroid."""
    return vectors.mapInArrow(_assigned(centroids, scale), "vec_id long, cluster int, distance long")


def cluster(
    embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, seed: str = SEED
) -> tuple[DataFrame, np.ndarray]:
    """The assignment of every kept vector, written once, and the final centroids."""
    vectors = staged(kept_vectors(embeddings, dimension), "kmeans-vectors")
    centroids = first_centroids(vectors, clusters, scale, seed)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    centroids = centroids_after(vectors, centroids, rounds, scale)
    return staged(assign(vectors, centroids, scale), "kmeans-clusters"), centroids


def clustered(embeddings: DataFrame, **options) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows, centroids = cluster(embeddings, **options)
    spark = embeddings.sparkSession
    total = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    found = {r.cluster: r.total for r in rows.groupBy("cluster").agg(total.alias("total")).collect()}  # a row per cluster

    def long(value) -> int | None:
        return None if value is None or value > LONG_MAX else int(value)

    inertia = long(None if None in found.values() else sum(map(int, found.values())))
    texts = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    about = [(c, long(found.get(c)), inertia, sha) for c, sha in zip(count(), texts)]
    names = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = rows.join(F.broadcast(names), "cluster")  # a row per cluster, a parameter
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


# --- twin --------------------------------------------------------------------------------------


def _round_sql(i: int) -> str:
    """Assignment to the centroids c{i} and the centroids after it."""
    return f"""
a{i} AS (
  SELECT row_no, any_value(v) AS v, min({{'d': d, 'c': c}}) AS best
  FROM (SELECT k.row_no, k.v, c{i}.c,
          list_sum(list_transform(list_zip(k.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
        FROM kept k, c{i})
  GROUP BY row_no),
m{i} AS (
  SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v
  FROM (SELECT best.c AS c, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS n
        FROM a{i}, range(1, {DIMENSION + 1}) t(i) GROUP BY ALL)
  GROUP BY c),
c{i + 1} AS (SELECT c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))"""


ORACLE = f"""
WITH kept AS (
  SELECT row_number() OVER () AS row_no, vec_id,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSION}),
c0 AS (
  SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS c, v
  FROM (SELECT sha256('{SEED}:' || vec_id::VARCHAR) AS h, v FROM kept ORDER BY h LIMIT {CLUSTERS})),
{",".join(_round_sql(i) for i in range(ROUNDS + 1))},
found AS (SELECT row_no, best.c AS cluster, best.d AS distance FROM a{ROUNDS})
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256
FROM found JOIN kept USING (row_no) JOIN c{ROUNDS} ON c = cluster
"""
