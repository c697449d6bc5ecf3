"""Every named query against its SQL counterpart on the small tables."""

import os

import pytest

from korvane.plans import load
from oracle import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = load()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    res = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF)
    if res == "equal but empty":
        pytest.skip("no rows at this size")
    assert res is None, res


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
