"""Registered queries against their SQL on the small tables."""

import pytest

from tallyspark import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
