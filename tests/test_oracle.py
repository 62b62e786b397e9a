"""Every registered query against its DuckDB SQL on the sf0.01 tables."""

import pytest

import __spark_entry__ as E
import oracle_compare
from gridmeter.plans.catalog import REGISTRY
from oracle_compare import compare, duck

oracle_compare.EXACT = True  # doubles compared bit for bit, as a value hash would

from conftest import SF

SQLS = E.oracle_sql()
NAMES = sorted(REGISTRY)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, SF, name, E.queries()[name], SQLS.get(name), con)
    if name in SQLS:
        assert r["match"], r
    else:
        assert r["spark_rows"] > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["day", "hour", "demand", "price", "scarcity"]
