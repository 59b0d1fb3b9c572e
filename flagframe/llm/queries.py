"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flagframe.llm import binpack, dedup, harmonic, jaccard, language, lookup_kmeans, matrices, mixing, pii, topk, toxicity, turns, warc

ORACLE: dict[str, str] = {
    "op1_impact_topk": topk.ORACLE, "op5_source_mix": mixing.ORACLE, "op6_warc_chunks": warc.ORACLE,
    "op7_exact_dedup": dedup.ORACLE, "op11_turn_repair": turns.ORACLE, "op12_lookup_kmeans": lookup_kmeans.ORACLE,
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_impact_topk(spark, sf_dir):
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_toxicity(spark, sf_dir):
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_ngram_join(spark, sf_dir):
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents")).drop("key1", "key2")


def op4_language(spark, sf_dir):
    return language.languages(_table(spark, sf_dir, "documents"))


def op5_source_mix(spark, sf_dir):
    return mixing.mix_sizes(_table(spark, sf_dir, "documents"))


def op6_warc_chunks(spark, sf_dir):
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op7_exact_dedup(spark, sf_dir):
    return dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op8_token_matrices(spark, sf_dir):
    return matrices.token_matrices(_table(spark, sf_dir, "documents"))


def op9_personal_data(spark, sf_dir):
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op10_bin_slack(spark, sf_dir):
    return binpack.pack(_table(spark, sf_dir, "documents"))


def op11_turn_repair(spark, sf_dir):
    return turns.damaged_structure(_table(spark, sf_dir, "conversations"))


def op12_lookup_kmeans(spark, sf_dir):
    return lookup_kmeans.clustered(_table(spark, sf_dir, "embeddings"))


def op13_harmonic_packing(spark, sf_dir):
    return harmonic.piece_digests(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}
