"""Every registered query against its SQL, on whole tables."""

import os

import pytest

import __spark_entry__ as entry
from graphmill.plans import building, evaluation, linking, matching, retrieving
from tests.compare import checker, differences

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()
GRAPH = [name for module in (building, matching, linking, evaluation, retrieving) for name in module.query.queries]


@pytest.fixture(scope="module")
def con():
    return checker(SF)


@pytest.mark.parametrize("name", sorted(GRAPH))
def test_matches_sql(spark, con, name):
    assert name in SQL
    assert differences(spark, con, QUERIES[name], SQL[name], SF) is None


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


def test_no_query_plans_a_cross_join(spark):
    for name in GRAPH:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
