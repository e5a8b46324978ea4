"""Queries of the training-data operators against their SQL."""

from __future__ import annotations

import pytest

from folia import llm
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query(spark, sf, name):
    compare(llm.queries()[name](spark, sf), llm.oracle_sql()[name], connect(sf))


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.queries()) == list(range(1, 11))


def test_entry_registers_all():
    import __spark_entry__ as entry

    assert set(llm.queries()) | {"pipeline"} <= set(entry.queries())
