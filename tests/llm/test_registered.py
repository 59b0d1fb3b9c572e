"""Every registered query of the subpackage with a DuckDB twin, and the pipeline."""

import pytest
from harness import differences, duck

import corpus_pipeline
from flagframe.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_duckdb(spark, sf_dir, name):
    assert differences(queries.queries()[name](spark, sf_dir), duck(sf_dir), queries.ORACLE[name]) is None


def test_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "source_mix", "best_fit_packing"]
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        rows = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(rows) < ids if name != "source_mix" else set(rows) <= ids
        ids = set(rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids
