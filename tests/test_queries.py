"""Every registered query that has SQL agrees with it."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_agrees_with_sql(spark, con, sf, name):
    result = compare(spark, con, sf, name)
    assert result.startswith("ok"), result


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
