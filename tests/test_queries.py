"""Every registered query with SQL against DuckDB at the smallest size."""

import pytest

import __spark_entry__ as entry_point
from kinetrail.plans import registry

from .oracle import connect, rows

SF = "/root/testdata/sf0.001"
#: Fits of trees and the like: one run each is enough.
SLOW = {"context_model", "leave_one_group_out"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, con, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = con.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL) - SLOW))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns[0] == "behavior" and df.count() == 4


def test_register_is_complete():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert set(registry.SQL) <= set(registry.QUERIES)
