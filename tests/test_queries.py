"""Every registered query of the engine against its DuckDB SQL, and the driver contract."""

import os

import pytest

import __spark_entry__ as contract
from riverlog import queries

from .oracle import connect, same


#: Queries name producers that smaller tables don't have.
DATA = os.environ.get("RIVERLOG_QUERY_DATA", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


def test_every_query_has_sql():
    assert set(queries.ORACLE_SQL) == set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert same(queries.QUERIES[name](spark, DATA), duck, queries.ORACLE_SQL[name]) == ""


def test_contract(spark):
    assert set(queries.QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())
    out = contract.entry(spark)
    assert out.columns == ["log_time", "producer", "topic", "sequence", "value"] and out.count() > 0
    times = [r["log_time"] for r in out.collect()]
    assert times == sorted(times)
