"""Contract queries against their DuckDB SQL on the sf0.01 tables."""

import pytest

import oracle_compare
from conftest import SF
from gridmeter.llm.catalog import QUERIES, SQL

oracle_compare.EXACT = True


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    r = oracle_compare.compare(spark, SF, name, QUERIES[name], SQL[name])
    assert r["match"], r


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
