"""Every registered query against its SQL in DuckDB on the smallest data."""

import pytest

from check import compare, connect
from tidewatch.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(catalog.REGISTRY))
def test_query(spark, con, name):
    ok, note = compare(spark, con, FOLDER, name)
    assert ok, note


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
