"""Every registered query against its SQL."""

import pytest
from conftest import DATA

import __spark_entry__ as entry
import workloads
from check import connect, difference


@pytest.fixture(scope="module")
def db():
    return connect(DATA)


def test_every_query_has_sql():
    assert set(workloads.QUERIES) == set(workloads.SQL)
    assert set(workloads.QUERIES) <= set(entry.queries())
    assert set(workloads.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", workloads.QUERIES)
def test_query(spark, db, name):
    assert difference(spark, db, entry.queries()[name], entry.oracle_sql()[name], DATA) is None


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
