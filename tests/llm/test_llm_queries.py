"""The contract queries against their SQL, on the smallest tables; the rest for shape."""

import pytest

import __spark_entry__ as spec
from check import compare, connect
from driftwarden.llm import queries


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_registered():
    names = [n for n in spec.queries() if n.startswith("op")]
    assert [f"op{i}_" for i in range(1, 14)] == sorted({n.split("_")[0] + "_" for n in names}, key=lambda n: int(n[2:-1]))
    assert "pipeline" in spec.queries() and set(queries.ORACLES) <= set(spec.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, sf, name):
    found = compare(spark, con, name, sf)
    assert found is None if name in queries.ORACLES else int(found.rsplit(" ", 1)[1]) > 0, found
