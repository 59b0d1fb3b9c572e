"""Operator 1: exact top-k search by inner product over an impact-ordered index.

Vectors are quantised to integers and dealt into index blocks of ``block_rows``. In a block every
dimension is a postings list cut into segments of equal levels. For a query, the impact of a
segment is what its level adds to a score above the least that its dimension can add.
Segments are processed score-at-a-time, by descending impact, into accumulators, which are
lower bounds. From time to time the k-th best lower bound is compared with the
upper bounds (accumulator, plus the widths of the levels, plus the largest impact left in
each dimension): processing stops when that proves all but a few vectors out. The
possible members are then scored exactly.

Queries are grouped too, and every group of queries meets every block once, so a task holds
one block and one group whatever the size of the table. The best k of the blocks are merged.

Defined cases: a vector that is null or holds a null or a non-finite component takes no part;
shorter vectors count as padded with zeros; an empty vector scores 0; of rows with one
vec_id, all are candidates of other queries, none is of its own, and the query is answered once for
each distinct vector; null ids take no part; ties go to the smaller vec_id. Scores are longs: where the largest
component and the width could carry one past 62 bits, the search raises instead of returning wrapped numbers. Columns
beside vec_id and embedding are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flagframe.session import staged

K = 5
BLOCK_ROWS = 16_384
GROUP_QUERIES = 4_096
LEVELS = 8
CHECK_EVERY = 32
FEW = 64
SCALE = 256


def quantised(embedding: Column) -> Column:
    """floor(256 * x) per component, null where the vector takes no part."""
    x = embedding.cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(sound, F.transform(x, lambda v: F.floor(v * SCALE).cast("long")))


class Block:
    """The index of one block: for each dimension the rows of each level, and the level's bounds."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS):
        self.ids, self.vectors = ids, vectors
        low, high = vectors.min(0), vectors.max(0)
        step = (high - low) // levels + 1
        rows, dims, least, most = [], [], [], []
        for d in range(vectors.shape[1]):
            level = (vectors[:, d] - low[d]) // step[d]
            order = np.argsort(level, kind="stable")
            cuts = np.searchsorted(level[order], np.arange(levels + 1))
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a < b:
                    members = order[a:b]
                    values = vectors[members, d]
                    rows.append(members)
                    dims.append(d)
                    least.append(values.min())
                    most.append(values.max())
        self.rows, self.dims = rows, np.array(dims, np.int64)
        self.least, self.most = np.array(least, np.int64), np.array(most, np.int64)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, scores) of the k best rows other than those of id ``own``."""
        candidates = self.possible(query, own, k)
        candidates = candidates[self.ids[candidates] != own]
        scores = self.vectors[candidates] @ query
        best = np.lexsort((self.ids[candidates], -scores))[:k]
        return candidates[best], scores[best]

    def possible(self, query: np.ndarray, own: int, k: int) -> np.ndarray:
        n, width = self.vectors.shape
        if n <= max(FEW, k) or not width or not len(self.dims):
            return np.arange(n)
        weight = query[self.dims]
        low = np.where(weight >= 0, self.least, self.most) * weight
        high = np.where(weight >= 0, self.most, self.least) * weight
        floor = np.full(width, np.iinfo(np.int64).max)
        np.minimum.at(floor, self.dims, low)
        impact, slack = low - floor[self.dims], np.zeros(width, np.int64)
        np.maximum.at(slack, self.dims, high - low)
        order = np.argsort(-impact, kind="stable")
        # the largest impact left in each dimension, summed, after each step
        left = np.zeros(width, np.int64)
        np.maximum.at(left, self.dims, impact)
        later = self._later(order, impact, left)
        spread = int(slack.sum())
        sums = np.zeros(n, np.int64)
        sums[self.ids == own] = np.iinfo(np.int64).min // 2
        for step, segment in enumerate(order):
            if impact[segment]:
                sums[self.rows[segment]] += impact[segment]
            if step % CHECK_EVERY == CHECK_EVERY - 1:
                keep = np.flatnonzero(sums + (int(later[step]) + spread) >= np.partition(sums, n - k)[n - k])
                if len(keep) <= max(FEW, n // 64):
                    return keep
        return np.flatnonzero(sums + spread >= np.partition(sums, n - k)[n - k])

    def _later(self, order: np.ndarray, impact: np.ndarray, left: np.ndarray) -> np.ndarray:
        """After each step, the sum over dimensions of the largest impact not yet processed."""
        dims = self.dims[order]
        by_dim = np.lexsort((np.arange(len(order)), dims))
        following = np.zeros(len(order), np.int64)
        same = dims[by_dim][1:] == dims[by_dim][:-1]
        following[by_dim[:-1][same]] = impact[order[by_dim[1:][same]]]
        return left.sum() - np.cumsum(impact[order] - following)


def _padded(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _searched(k: int, width: int, levels: int):
    def run(key, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "variant", "vec_id", "score"]
        if not len(index) or not len(queries):
            return pd.DataFrame({c: np.empty(0, np.int64) for c in columns})
        block = Block(index.vec_id.to_numpy(), _padded(index.v.to_list(), width), levels)
        vectors = _padded(queries.v.to_list(), width)
        parts = []
        for own, variant, vector in zip(queries.vec_id.to_numpy(), queries.variant.to_numpy(), vectors):
            rows, scores = block.search(vector, own, k)
            parts.append(np.column_stack([np.full(len(rows), own), np.full(len(rows), variant), block.ids[rows], scores]))
        return pd.DataFrame(np.concatenate(parts), columns=columns)

    return run


def top_k(embeddings: DataFrame, is_query: Column, k: int = K, block_rows: int = BLOCK_ROWS, group_queries: int = GROUP_QUERIES, levels: int = LEVELS) -> DataFrame:
    """Per query its k best rows by integer inner product: query_id, rank, vec_id, score."""
    vectors = staged(
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"))
        .where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
        .withColumn("deal", F.monotonically_increasing_id()),
        "topk-vectors",
    )
    largest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.count_if(is_query).alias("queries"), F.max(largest).alias("largest")).first()
    if (size["width"] or 0) * (size["largest"] or 0.0) ** 2 >= 2**62:
        raise ValueError(f"inner products of components up to {size['largest']:.3g} do not fit a long")
    blocks, groups = -(-size["n"] // block_rows) or 1, -(-size["queries"] // group_queries) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block, group = F.pmod(F.xxhash64("deal"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)).cast("int")
    # each block meets each group of queries once: (block, group) is one task's work
    index = vectors.select("vec_id", "v", block.alias("block"), every(groups).alias("group"))
    queries = (
        vectors.where(is_query).select("vec_id", "v").distinct()
        .select("vec_id", "v", F.xxhash64("v").alias("variant"), group.alias("group"), every(blocks).alias("block"))
    )
    found = index.groupBy("block", "group").cogroup(queries.groupBy("block", "group")).applyInPandas(
        _searched(k, size["width"] or 0, levels), "query_id long, variant long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id", "variant").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
