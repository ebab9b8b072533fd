"""Every registered query against its SQL twin on whole tables."""

import pytest

import __spark_entry__ as entry
from mendframe.plans.registry import QUERIES
from oracle import compare, connect

entry.queries()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    rows, problem = compare(spark, con, QUERIES[name], sf)
    assert problem is None, problem
    assert rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
