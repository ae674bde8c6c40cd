"""Every named query against the SQL that states its result, on the smallest tables."""

import pytest

import __spark_entry__ as spec
from check import compare, connect
from driftwarden import catalog


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_entry(spark):
    assert spec.entry(spark).count() == 3


def test_every_sql_has_a_query():
    assert set(spec.oracle_sql()) <= set(spec.queries())


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, sf, name):
    found = compare(spark, con, name, sf)
    if name in spec.oracle_sql():
        assert found is None, found
    else:
        assert int(found.rsplit(" ", 1)[1]) > 0
