"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect
from worldstate.plans import ORACLES, QUERIES

# empty on the smallest tables by their nature
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, small, name):
    problem = compare(spark, con, name, QUERIES[name], ORACLES.get(name), small)
    assert problem == "" or (problem == "both empty" and name in MAY_BE_EMPTY)


def test_entry(spark):
    assert entry(spark).columns == ["zone_id", "name", "players"]


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries()) and set(QUERIES) <= set(queries())
