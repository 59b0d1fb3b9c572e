"""Operator 5: mixing sources to target weights with hash-threshold histograms.

Every row carries a 36-bit hash of its id, read as three 12-bit digits. Tokens are
summed by source and first digit; the running sum shows in which bucket a source's
budget ends. Only that bucket is summed again by the second digit, and the bucket
found there by the third, so a source's budget becomes one hash threshold and rows
are kept by a comparison, without sorting them. Smaller budgets give lower thresholds
over the same hash, so the rows taken for a small budget are a subset of those taken
for a large one, and reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own, last in
order; null ids hash as the empty string; rows with one id share one hash and are taken
together; rows of size 0 and empty tables take nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flagframe.session import staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
BITS, LEVELS = 12, 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(doc_id: Column) -> Column:
    """36 bits of the MD5 of the id, alike in every engine."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS * LEVELS // 4), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights=WEIGHTS, budget=BUDGET, most=MOST) -> DataFrame:
    """Targets of the sources (source, source_size): one row each, so one window over them is small.

    A source gets weight * level, or its cap of ``most`` times its size if that is less. Sorted
    by cap over weight the capped sources come first. Taking those before a source as capped and spreading the
    rest of the budget over the weights from there on gives a level; of the levels that do not exceed
    their own source's cap the largest is the one that spends the budget.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(ordered) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1)
    by_cap = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levelled = (
        totals.withColumn("_weight", weight)
        .withColumn("_cap", F.col("source_size") * most)
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_rest", F.lit(budget) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_level", F.col("_rest") / F.sum("_weight").over(from_here))
        .withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything))
    )
    target = F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_weight") * F.col("_level"), F.lit(0.0)))
    return levelled.select("source", "source_size", target.alias("target"))


def mix_plan(sized: DataFrame, weights=WEIGHTS, budget=BUDGET, most=MOST) -> DataFrame:
    """One row per source: source_size, target, whole copies and the hash under which a row is taken once more.

    ``sized`` has source, size and hash. Each pass sums only the bucket in which a budget ends.
    """
    digit = lambda level: F.shiftright("hash", BITS * (LEVELS - 1 - level)).bitwiseAND((1 << BITS) - 1)
    first = staged(
        sized.groupBy("source", digit(0).alias("digit")).agg(F.sum("size").alias("tokens")), "mix-histogram"
    )
    targets = source_targets(first.groupBy("source").agg(F.sum("tokens").alias("source_size")), weights, budget, most)
    copies = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    plan = staged(
        targets.withColumn("copies", copies.cast("long"))
        .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
        .withColumns({"prefix": F.lit(0).cast("long"), "below": F.lit(0).cast("long"), "last": F.lit(0).cast("long")}),
        "mix-targets",
    )
    histogram = first
    for level in range(LEVELS):
        if level:
            histogram = (
                sized.alias("s")
                .join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")) & (F.shiftright("hash", BITS * (LEVELS - level)) == F.col("p.prefix")) & (F.col("p.rest") > 0))
                .groupBy(F.col("s.source").alias("source"), digit(level).alias("digit"))
                .agg(F.sum("size").alias("tokens"))
            )
        running = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        ended = (
            histogram.withColumn("upto", F.sum("tokens").over(running)).alias("h")
            .join(plan.alias("p"), F.col("h.source").eqNullSafe(F.col("p.source")))
            .where(
                (F.col("rest") > 0)
                & (F.col("below") + F.col("upto") >= F.col("rest"))
                & (F.col("below") + F.col("upto") - F.col("tokens") < F.col("rest"))
            )
            .select(F.col("p.source").alias("found"), "digit", F.col("upto").alias("reached"), "tokens")
        )
        plan = staged(
            plan.join(ended, F.col("source").eqNullSafe(F.col("found")) & F.col("digit").isNotNull(), "left").select(
                "source", "source_size", "target", "copies", "rest",
                (F.col("prefix") * (1 << BITS) + F.coalesce("digit", F.lit(0))).alias("prefix"),
                (F.col("below") + F.coalesce(F.col("reached") - F.col("tokens"), F.lit(0))).alias("below"),
                F.coalesce("tokens", F.lit(0)).alias("last"),
            ),
            "mix-boundary",
        )
    nearer = (F.col("below") + F.col("last") - F.col("rest")) <= (F.col("rest") - F.col("below"))
    threshold = F.when(F.col("rest") > 0, F.col("prefix") + F.when(nearer, 1).otherwise(0)).otherwise(0)
    return staged(plan.select("source", "source_size", "target", "copies", threshold.alias("threshold")), "mix-plan")


def with_copies(rows: DataFrame, plan: DataFrame, source: str, key: Column) -> DataFrame:
    """Join the plan of each row's source; adds ``_plan`` and ``_times``, how often the row is taken."""
    packed = plan.select(F.col("source").alias("_source"), F.struct("source_size", "target", "copies", "threshold").alias("_plan"))
    times = F.col("_plan.copies") + F.when(key < F.col("_plan.threshold"), 1).otherwise(0)
    return rows.join(packed, F.col(source).eqNullSafe(F.col("_source")), "left").drop("_source").withColumn("_times", times)


def mix_sizes(docs: DataFrame, weights=WEIGHTS, budget=BUDGET, most=MOST) -> DataFrame:
    """Per document: doc_id, size, source_size, target and the words taken of it (0, 1 or 2 times its size)."""
    sized = staged(
        docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("hash")),
        "mix-sizes",
    )
    taken = with_copies(sized, mix_plan(sized, weights, budget, most), "source", F.col("hash"))
    return taken.select(
        "doc_id", "size", "source", F.col("_plan.source_size").alias("source_size"), F.col("_plan.target").alias("target"),
        (F.col("size") * F.col("_times")).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame, weights=WEIGHTS, budget=BUDGET, most=MOST) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: left out, once, or as often as their source's target asks."""
    doc_id = F.col("doc_id")
    sized = staged(docs.select(F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), id_hash(doc_id).alias("hash")), "mix-sizes")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col("source").cast("string").alias("_of"), id_hash(doc_id).alias("_hash"))
    taken = with_copies(rows, mix_plan(sized, weights, budget, most), "_of", F.col("_hash"))
    repeated = taken.where("_times > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("_copy"))
    return repeated.select("_row.*")


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
    CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9)) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, 2 * source_size AS cap, CAST(2 * source_size AS DOUBLE) / w AS ratio FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
      - CAST(coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
      / CAST(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lv
  FROM r
), t AS (
  SELECT source, source_size,
    least(CAST(cap AS DOUBLE), coalesce(w * (max(CASE WHEN lv <= ratio THEN lv END) OVER ()), 0.0::DOUBLE)) AS target FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(2, CAST(floor(target / source_size) AS BIGINT)) ELSE 0 END AS copies FROM t
), q AS (
  SELECT *, target - copies * source_size AS rest FROM p
), g AS (
  SELECT q.*, x.doc_id, x.size, x.h, x.upto, x.upto - x.at_h AS before FROM (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
      sum(size) OVER (PARTITION BY source, h) AS at_h FROM d) x
  JOIN q ON x.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source, source_size, target,
  CAST(size * (copies + CASE WHEN rest > 0 AND (upto < rest OR (before < rest AND upto - rest <= rest - before)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM g
"""
