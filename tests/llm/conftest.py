from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows, with extra columns of clashing names."""

    def make(rows):
        rows = [(*r, *[None] * (4 - len(r)), 0, "x", -1) for r in rows]
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long, size string, score long"
        )

    return make
