"""Small helpers for the llm tests; the session comes from tests/conftest.py."""

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text, lang) rows, with an extra column whose name clashes with internals."""
    def make(rows):
        rows = [(*r, None)[:3] for r in rows]
        return spark.createDataFrame([(i, t, x, "b") for i, t, x in rows], "doc_id long, text string, lang string, block string")

    return make
