"""Every query with SQL gives the same rows in DuckDB; the others give rows."""

from __future__ import annotations

import pytest

from passagework import catalog
from passagework.cluster import cut
from passagework.plans import legal_queries
from tests.compare import duck_rows, spark_rows


@pytest.fixture(scope="module", autouse=True)
def flattened_once():
    """The legal queries share what they are made of: files are parsed and flattened once, not once a query."""
    held: dict = {}
    real = legal_queries.parts

    def once(spark, d, *names):
        for n in names:
            if (d, n) not in held:
                held[d, n] = cut(real(spark, d, n)[0])
        return [held[d, n] for n in names]

    legal_queries.parts = once
    yield
    legal_queries.parts = real


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, name):
    names, rows = spark_rows(catalog.QUERIES[name](spark, data))
    if name in catalog.ORACLES:
        assert (names, rows) == duck_rows(catalog.ORACLES[name], data)
    else:
        assert rows


def test_entry_points():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
