"""Every registered query against its DuckDB oracle at sf0.01."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from conftest import SF_CHECK, SF_SMALL
from fleetbook.plans.catalog import queries
from fleetbook.plans.oracle import oracle_sql
from oracle_harness import compare

QUERIES = queries()
ORACLES = oracle_sql()


def test_entry_file_registers_every_query():
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


def test_every_query_has_an_oracle():
    assert sorted(QUERIES) == sorted(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, duck_check, name):
    problems, n, _, _ = compare(spark, duck_check, name, QUERIES[name], ORACLES[name], SF_CHECK)
    assert not problems, problems


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["entry_date", "income", "expenses", "net", "rental"]
    assert E.entry(spark).schema == df.schema


def test_queries_run_on_smallest_scale(spark):
    # every query plans and runs on sf0.001 as well
    for name, fn in QUERIES.items():
        fn(spark, SF_SMALL).write.format("noop").mode("overwrite").save()


FORBIDDEN = ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas",
             "CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_python_and_no_cross_join(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [f for f in FORBIDDEN if f in plan]
