"""Each registered analytics query against DuckDB at the smallest scale."""

import os

import pytest

from lodestrata.plans import registry
from oracle import DATA, assert_same, connect

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    assert assert_same(QUERIES[name](spark, DATA), con, ORACLE[name]) > 0  # an empty answer would show nothing


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
