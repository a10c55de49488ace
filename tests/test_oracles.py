"""Every registered query against its SQL on the smallest tables."""

import pytest

from panelstat import registry
from tests.oracle import compare

ENTRIES = registry.load()


@pytest.mark.parametrize("name", [n for n, (_, sql) in ENTRIES.items() if sql is not None])
def test_matches_sql(spark, sf, name):
    fn, sql = ENTRIES[name]
    ok, message = compare(fn(spark, sf), sql, sf)
    assert ok, message


def test_entry_point():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(ENTRIES) <= set(e.queries())
