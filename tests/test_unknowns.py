"""Missing counts, scores and calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from runsieve.operators.aggregate import metric_aggregates
from runsieve.operators.gate import gate, run_actions
from runsieve.operators.traces import planned_tools
from runsieve.operators.verdicts import judge_requests

CALLS = "struct<answer:string,tool_calls:array<struct<name:string,arguments:string,result:string>>>"


def test_runs_of_unknown_size_are_not_gated(spark):
    schema = "id string, status string, n_results bigint, total_cases bigint, completed_shards bigint, total_shards bigint, created_at string, force boolean"
    now, old = "2024-01-01 00:05:00", "2023-12-31 00:00:00"
    rows = [
        ("no totals", "running", 3, None, 1, None, now, None),
        ("no counts", "running", None, 5, None, 2, now, None),
        ("shards known", "running", None, None, 2, 2, now, None),
        ("no totals, old", "running", None, None, None, None, old, None),
        ("no age", "running", 1, 5, 0, 2, None, None),
    ]
    runs = spark.createDataFrame(rows, schema).withColumn("created_at", F.to_timestamp("created_at"))
    got = {r["id"]: (r["complete"], r["action"]) for r in run_actions(runs, F.lit("2024-01-01 00:10:00").cast("timestamp")).collect()}
    assert got == {
        "no totals": (False, "wait"), "no counts": (False, "wait"), "shards known": (True, "aggregate"),
        "no totals, old": (False, "aggregate"), "no age": (False, "wait"),
    }


def test_scores_that_are_none_have_no_part(spark):
    values = [0.8, 0.9, None, float("nan"), 1.5, -0.1]
    scores = spark.createDataFrame([("r", f"c{i}", "faithfulness", v) for i, v in enumerate(values)], "eval_run_id string, case_id string, metric string, score double")
    runs = spark.createDataFrame([("r",)], "eval_run_id string")
    row = metric_aggregates(scores, runs).filter("metric = 'faithfulness'").first()
    assert row["n"] == 2 and abs(row["mean"] - 0.85) < 1e-12


def test_a_trace_without_calls_plans_none(spark):
    rows = spark.createDataFrame([([], ("a", None), ["x"]), ([], None, ["x"]), (["t"], ("a", None), ["x"])], f"e array<string>, r {CALLS}, c array<string>")
    assert [r[0] for r in rows.select(planned_tools(F.col("e"), F.col("r"), F.col("c"))).collect()] == [[], ["search_docs"], ["t"]]


def test_judge_limit_keeps_its_digits(case_row):
    texts = [r["user_text"] for r in judge_requests(case_row(), {"faithfulness": 0.875}).collect()]
    assert sum("Passing score: 0.875." in t for t in texts) == 1 and sum("Passing score: 0.85." in t for t in texts) == 1


def test_unknown_numbers_fail_the_gate(spark):
    schema = "id string, overall_score double, error_rate double, completed_cases bigint, total_cases bigint, timed_out boolean"
    rows = [
        ("good", 0.9, 0.0, 5, 5, False), ("no score", None, 0.0, 5, 5, False), ("no rate", 0.9, None, 5, 5, False), ("NaN", float("nan"), 0.0, 5, 5, False),
        ("no clock", 0.9, 0.0, 5, 5, None), ("no count", 0.9, 0.0, None, 5, False), ("late", 0.9, 0.0, 0, None, True),
    ]
    limits = F.struct(F.lit(0.85).alias("overall"), F.lit(0.05).alias("max_error_rate"))
    got = {r["id"]: (r["status"], r["gate_passed"]) for r in gate(spark.createDataFrame(rows, schema).withColumn("thresholds", limits)).collect()}
    assert got.pop("good") == ("pass", True) and got.pop("late") == ("timeout", False)
    assert set(got.values()) == {("fail", False)}
