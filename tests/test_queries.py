"""Every registered query of the layout engine against its SQL, or for rows."""

from __future__ import annotations

import pytest

from folia import registry
from tests.oracle import compare, connect

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        compare(df, ORACLES[name], con)
    else:
        assert df.count() > 0


def test_entry_imports_without_optional_parts():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
