"""Every registered query against its DuckDB text at the smallest scale factor."""

import pytest

import __spark_entry__ as entry_module
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_oracle(spark, con, name):
    problem, _ = compare(spark, con, SF, name, QUERIES[name], ORACLES[name])
    assert not problem


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_query_without_oracle_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert {r["verdict"] for r in rows} <= {"pass", "trim_required", "fail"} and rows
