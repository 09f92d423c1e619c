"""Every named query against its SQL counterpart, and what its plan may contain."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from compare import connect, difference
from starloom.plans.registry import load_all

FOLDER = "/root/testdata/sf0.001"
REGISTERED = load_all()
QUERIES, SQL = REGISTERED.callables(), REGISTERED.sql

# Chained joins and how often each table may be scanned when nothing can be broadcast.
MOST_SCANS = {
    "fact_exam": {"lineitem": 1, "orders": 1},
    "fact_enrollment": {"orders": 1},
    "attempt_consolidation": {"lineitem": 2, "orders": 2},
    "upsert_partial": {"orders": 5},
    "dim_flatten_chain": {"supplier": 1, "nation": 1, "region": 1},
    "attempt_history_filter": {"lineitem": 3},
}
# A column that tells the table of a scan.
KEY_COLUMNS = {
    "lineitem": "l_linenumber", "orders": "o_orderkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey",
}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) and set(QUERIES) <= set(entry_points.queries())


@pytest.fixture
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("name", MOST_SCANS)
def test_chained_joins_scan_each_table_once(spark, duck, no_broadcast, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    leaves = [line for line in plan.splitlines() if "Relation [" in line]
    found = {t: sum(marker in x for x in leaves) for t, marker in KEY_COLUMNS.items()}
    assert all(found[t] <= most for t, most in MOST_SCANS[name].items()), found
    assert difference(df.toPandas(), duck.execute(SQL[name]).df()) is None


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert node not in plan
    assert difference(df.toPandas(), duck.execute(SQL[name]).df()) is None
