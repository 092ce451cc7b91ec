"""Every registered query against its SQL, exactly, on the smallest tables."""

import pytest

from suite.compare import connect, differences
from suite.oracle import ORACLE
from suite.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert len(QUERIES) == 57


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, connection, name):
    assert differences(spark, connection, SF_DIR, name) == []


def test_entry_contract(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.columns == ["item", "step", "step_name", "segment", "band_order", "band", "count", "percentage"]
    assert rows.count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())
