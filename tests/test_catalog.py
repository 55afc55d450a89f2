"""Every registered query gives the rows of its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as contract
from chronowatt import catalog
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    ok, note = compare(spark, con, SF, name)
    assert ok, note


def test_entry_gives_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries())
