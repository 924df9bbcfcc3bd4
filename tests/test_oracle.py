"""Every registered query against DuckDB on the same tables."""

import pytest

import __spark_entry__ as entry
from clipledger import catalog
from checks.compare import compare, connect

ORACLE = {name: text for name, text in entry.oracle_sql().items() if name in catalog.queries()}
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
         "decimal(20,0)": "DECIMAL(20,0)"}


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches(spark, duck, small, name):
    got = compare(spark, duck, entry.queries()[name], ORACLE[name], small)
    assert got["ok"], got
    for column, (mine, theirs) in got["types"].items():
        assert KINDS[mine] == theirs, (column, mine, theirs)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(ORACLE)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
