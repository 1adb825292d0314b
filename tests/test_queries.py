"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import compare, database

import __spark_entry__ as entry
from cohortloom.sources.views import Views

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.QUERIES
SQL = {n: s for n, s in entry.oracle_sql().items() if n in QUERIES}


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    assert compare(df, con, entry.oracle_sql()[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = Views(spark, FOLDER).chart._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "l_returnflag" in line and "FileScan" in line)
    assert "EqualTo(l_returnflag,R)" in scan and "l_extendedprice" not in scan


def test_entry(spark):
    df = entry.entry(spark)
    assert {"sensitivity", "specificity", "kappa"} <= set(df.columns)
