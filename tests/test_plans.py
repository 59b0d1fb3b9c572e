"""Plans of the registered queries: no pair-forming joins, no Python rows, few shuffles."""

import re

import pytest

from flagframe.operators import textscan
from flagframe.plans.queries import queries

QUERIES = queries()
STREAMS = {n for n in QUERIES if n.startswith("stream_")}


def plan(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def shuffles(text):
    return len(re.findall(r"(?<!Reused)(?<!Broadcast)Exchange (?:hash|range|Round)", text))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_pairs_and_no_python(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    if name != "versions":  # orders arrays of any length
        assert "SortAggregate" not in text
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert bad not in text


@pytest.mark.parametrize(
    "name", ["flags_pack", "flags_unpack", "flags_filter", "flags_decode", "flags_dispatch", "mask_literals", "mask_roundtrip",
             "pseudonymise", "pseudonymise_medium", "pseudonymise_high", "token_profile", "registry_rows", "tag_keywords", "first_line", "count_lines", "rebase_paths", "check_rows", "checksums", "project_issues"],
)
def test_narrow(spark, sf_dir, name):
    assert "Exchange" not in plan(spark, sf_dir, name)


def test_text_work_is_narrow(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiled = textscan.token_profile(documents, ["doc_id"], "text")
    assert "Exchange" not in profiled._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["order_flags", "flags_fold", "flags_counts", "flags_union", "flags_stages", "job_state", "complexity",
             "size_report", "check_summary", "registers_tumbling"],
)
def test_one_shuffle_after_partial_aggregation(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert shuffles(text) == 1 and "partial_" in text


def test_comparison_shuffles_values_once(spark, sf_dir):
    text = plan(spark, sf_dir, "compare")
    assert shuffles(text) == 2 and "Join" not in text


def test_columns_are_pruned(spark, sf_dir):
    text = plan(spark, sf_dir, "order_flags")
    scanned = re.search(r"FileScan parquet \[([^\]]*)\]", text).group(1)
    assert set(re.findall(r"(\w+)#", scanned)) == {
        "l_orderkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    }
