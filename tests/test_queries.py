"""Every registered query against its SQL check, and what plans must not contain."""

import os

import pytest
from checking import compare, connect

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLE:
        assert compare(df, con, ORACLE[name]) is None
    else:
        assert df.count() > 0


@pytest.mark.parametrize(
    "name", ["sessions", "session_features", "events_in_session", "label_sessions", "ttd_per_incident", "sequences"]
)
def test_no_pairwise_joins(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
