"""Every registered query against its SQL, and the shape of its plan."""

from __future__ import annotations

import re

import pytest

from oracle import compare, duck
from runsieve.catalog import all_oracles, all_queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql_and_plan_is_sound(spark, con, name):
    assert name in ORACLES, "a query without SQL needs its own brute-force test"
    plans = []

    def run(session, sf_dir):
        df = QUERIES[name](session, sf_dir)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    ok, text = compare(spark, con, SF, run, ORACLES[name])
    assert ok, text
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|Exchange SinglePartition", plans[0])


def test_names_and_entry(spark):
    import __spark_entry__ as entry_module

    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert entry_module.entry(spark).count() == 8


def test_lines_scan_reads_only_needed_columns(spark):
    plan = QUERIES["results_dedup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_tax" not in plan
    plan = QUERIES["open_runs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_orderdate:timestamp_ntz>" in plan
