"""Every registered query against DuckDB at the smallest scale."""
from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from checks.compare import difference, duck

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ours = entry.queries()[name](spark, SF_DIR).toPandas()
    assert len(ours) > 0
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        assert difference(ours, con.sql(sql).df()) is None
