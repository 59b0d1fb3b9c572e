"""Every registered query against its DuckDB twin."""

import pytest

import __spark_entry__ as entry_module
from harness import differences, duck

QUERIES = entry_module.queries()
ORACLE = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLE[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_queries_without_oracle_run(spark, sf_dir):
    for name in set(QUERIES) - set(ORACLE):
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["l_orderkey", "flags", "flag_names", "n_flags"]
    assert df.count() > 0
