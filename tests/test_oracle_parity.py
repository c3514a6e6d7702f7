"""Every registered query equals its DuckDB oracle on the smallest test tables
(row count, column types and every value)."""

import os

import pytest

import __spark_entry__ as E
from oracle_check import compare, duck
from promolift.plans import oracle, registry

SF = os.environ.get("PROMOLIFT_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(oracle.oracle_sql())
    assert set(registry.queries()) <= set(E.queries()) and set(oracle.oracle_sql()) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, name, SF, con)
    assert res["status"] == "exact", res


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "recommended_mechanic" in df.columns
