"""Every registered query against its DuckDB oracle on the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as E  # noqa: E402
from prefspark.plans.catalog import QUERIES  # noqa: E402
from oracle_check import duck, rows_of  # noqa: E402

SF = os.environ.get("PREFSPARK_TEST_SF", "/root/testdata/sf0.001")
ORACLE = E.oracle_sql()
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = df.collect()
    if name not in ORACLE:
        assert len(df.columns) > 0
        return
    rel = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    drows = rel.fetchall()
    assert len(rows) == len(drows)
    assert rows_of(df.columns, rows, 9) == rows_of(rel.columns, drows, 9)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["split", "player_i", "player_j", "win_rate"]
    assert df.count() > 0
