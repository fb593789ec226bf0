"""Every registered query against its SQL, and checks of the plans."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import compare, duck
from frostline.plans.catalog import QUERIES
from frostline.plans.oracle import ORACLE

STREAMS = [n for n in QUERIES if n.startswith("stream_")]
BATCH = [n for n in QUERIES if n not in STREAMS]


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE) and set(ORACLE) <= set(oracle_sql())


def test_flagship_counts(spark):
    rows = entry(spark).collect()
    assert len(rows) == 137 and sum(r.is_breached for r in rows) == 10


@pytest.mark.parametrize("name", BATCH + (STREAMS if os.environ.get("TEST_STREAM_QUERIES") else []))
def test_query_matches_its_oracle(spark, con, sf_dir, name):
    ok, note = compare(spark, con, name, sf_dir)
    assert ok, note


@pytest.mark.parametrize("name", BATCH)
def test_plan_has_no_cross_join_and_no_python(spark, sf_dir, name):
    plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in plan


@pytest.mark.parametrize(
    "name, columns",
    [
        ("events_by_customer", "struct<user_id:bigint>"),
        ("latency_histogram", "struct<value:double>"),
        ("window_aggregates", "struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>"),
        ("route_filter", "struct<user_id:bigint>"),
    ],
)
def test_scan_reads_only_what_is_needed(spark, sf_dir, name, columns):
    plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert f"ReadSchema: {columns}" in plan
