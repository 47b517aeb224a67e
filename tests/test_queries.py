"""Every registered query against its SQL, and the shape of the plans."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from __spark_entry__ import entry, oracle_sql, queries as registered  # noqa: E402
from check import compare  # noqa: E402
from tidemark.plans.oracle import ORACLE  # noqa: E402
from tidemark.plans.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = ("events", "orders", "lineitem", "customer")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def queries():
    """The queries of this library's own operators; other subpackages test theirs."""
    return QUERIES


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(registered()) and set(ORACLE) <= set(oracle_sql())
    assert set(oracle_sql()) <= set(registered())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    message, good = compare(spark, con, name, SF)
    assert good, message


def test_entry(spark):
    assert entry(spark).columns == ["key", "event_type", "value", "k", "last_seq"]


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_cross_join(spark, name):
    plan = physical(queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = queries()["key_lookup"](spark, SF)._jdf.queryExecution().toString()
    assert "EqualTo(key,000000000000000000000001)" in plan
    plan = queries()["state_as_of"](spark, SF)._jdf.queryExecution().toString()
    assert "LessThanOrEqual(event_id," in plan
    plan = queries()["apply_deletes"](spark, SF)._jdf.queryExecution().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line and "lineitem" in line]
    assert scans and all("l_extendedprice" not in line.split("ReadSchema")[1] for line in scans)


def test_join_back_finds_winners_by_hash(spark):
    plan = physical(queries()["apply_changes_join_back"](spark, SF))
    lines = [line for line in plan.split("\n") if "last_insert" in line and "Aggregate" in line]
    assert lines and all("HashAggregate" in line for line in lines)
