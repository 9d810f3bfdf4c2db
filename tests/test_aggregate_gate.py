from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from runsieve.operators import aggregate as agg
from runsieve.operators import gate as G
from runsieve.operators import reports as rep
from runsieve.plans.evaluate import results_to_reports
from runsieve.schemas import METRICS, Thresholds

_RESULT = (
    "eval_run_id string, case_id string, error string, input_tokens bigint, output_tokens bigint, "
    "metrics array<struct<name:string,score:double,passed:boolean>>"
)


def _results(spark, rows):
    """rows: (run, case, error, [(name, score)])."""
    full = [(run, case, err, 1000, 200, [(n, float(s), s >= 0.7) for n, s in metrics]) for run, case, err, metrics in rows]
    df = spark.createDataFrame(full, _RESULT)
    passed = agg.case_passed(F.col("error"), F.col("metrics"))
    return df.withColumn("case_passed", passed).withColumn("has_error", F.coalesce(F.col("error") != "", F.lit(False)))


def _all(scores):
    return list(zip(METRICS, scores, strict=True))


def _reports(spark, rows, runs=None, thresholds=None):
    table = None
    if runs is not None:
        table = spark.createDataFrame(runs, "eval_run_id string, total_cases bigint, timed_out boolean")
    return {r["eval_run_id"]: r for r in results_to_reports(_results(spark, rows), table, thresholds).collect()}


def test_gate_outcomes(spark):
    rows = [("good", f"c{i}", None, _all((0.9, 0.85, 1.0))) for i in range(10)]
    rows += [("low", "c", None, _all((0.2, 0.9, 1.0))), ("edge", "c", None, _all((0.85, 0.85, 0.85)))]
    rows += [("errs", f"c{i}", "boom" if i == 0 else None, [] if i == 0 else _all((1, 1, 1))) for i in range(20)]
    rows += [("errs2", f"c{i}", "boom" if i < 2 else None, [] if i < 2 else _all((1, 1, 1))) for i in range(20)]
    runs = [("good", 10, False), ("low", 1, False), ("edge", 1, False), ("none", 4, True), ("empty", 0, False), ("part", 4, False)]
    runs += [("errs", 20, False), ("errs2", 20, True)]
    got = _reports(spark, rows, runs)
    assert got["good"]["status"] == "pass" and got["good"]["metrics"][0]["mean"] == 0.9
    assert got["good"]["overall_score"] == round(statistics.mean([0.9, 0.85, 1.0]), 4)
    assert got["low"]["status"] == "fail" and len(got["low"]["failures"]) == 1
    assert got["edge"]["status"] == "pass" and got["edge"]["overall_score"] == 0.85
    assert got["none"]["status"] == "timeout" and got["none"]["error_rate"] == 1.0 and len(got["none"]["failures"]) == 4
    assert got["empty"]["status"] == "fail" and got["empty"]["error_rate"] == 0.0
    assert got["part"]["status"] == "fail" and got["part"]["error_rate"] == 1.0
    assert got["errs"]["status"] == "pass" and got["errs"]["error_rate"] == 0.05  # exactly at the limit
    assert got["errs2"]["status"] == "fail" and got["errs2"]["failures"][1] == "error rate 10.00% is above 5.00%"
    assert (got["errs2"]["completed_cases"], got["errs2"]["error_cases"], got["errs2"]["failed_cases"]) == (20, 2, 0)
    assert got["good"]["estimated_cost_usd"] == round(10 * 1000 / 1e6 * 0.8 + 10 * 200 / 1e6 * 4.0, 6)
    assert all(len(r["metrics"]) == 3 for r in got.values())
    assert got["none"]["metrics"][0]["gated"] and got["none"]["metrics"][0]["n"] == 0


def test_means_at_the_threshold_are_not_flagged(spark):
    rows = [("r", f"c{i}", None, _all((0.85, 0.85, 0.85))) for i in range(7)]
    report = _reports(spark, rows)["r"]
    assert report["status"] == "pass" and not any(m["gated"] for m in report["metrics"])


def test_repeated_and_unknown_names(spark):
    metrics = [(METRICS[0], 0.1), ("politeness", 0.2), (METRICS[0], 1.0), (METRICS[1], 1.0)]
    report = _reports(spark, [("r", "c", None, metrics)])["r"]
    assert [m["n"] for m in report["metrics"]] == [1, 1, 0]
    assert report["metrics"][0]["mean"] == 1.0  # the last copy counts
    assert report["passed_cases"] == 0  # every copy must pass
    assert report["overall_score"] == 1.0


def test_custom_thresholds(spark):
    report = _reports(spark, [("r", "c", None, _all((0.6, 0.6, 0.6)))], thresholds=Thresholds(overall=0.5, faithfulness=0.55))["r"]
    assert report["status"] == "pass" and [m["gated"] for m in report["metrics"]] == [False, True, True]
    with pytest.raises(ValueError):
        Thresholds(overall=1.5)


def _percentile(values, pct):
    rank = (len(values) - 1) * pct
    low = int(rank)
    high = min(low + 1, len(values) - 1)
    return values[low] if rank == low else values[low] * (1 - (rank - low)) + values[high] * (rank - low)


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_aggregates_match_python(spark, parts):
    rng = random.Random(11)
    groups = {("hot", METRICS[0]): [rng.choice([0.5, rng.random(), 1.0]) for _ in range(900)]}
    groups[("small", METRICS[1])] = [0.25, 0.75]
    groups[("one", METRICS[2])] = [1.0]
    groups[("same", METRICS[2])] = [0.3] * 50
    rows = [(run, f"c{i}", m, v) for (run, m), values in groups.items() for i, v in enumerate(values)]
    rng.shuffle(rows)
    scores = spark.createDataFrame(rows, "eval_run_id string, case_id string, metric string, score double").repartition(parts)
    runs = spark.createDataFrame([(r,) for r, _ in groups], "eval_run_id string")
    got = {(r["eval_run_id"], r["metric"]): r for r in agg.metric_aggregates(scores, runs).collect()}
    assert len(got) == 12
    for key, values in groups.items():
        ordered, row = sorted(values), got[key]
        assert row["n"] == len(values)
        assert row["mean"] == round(statistics.mean(values), 4)
        assert row["p50"] == round(statistics.median(values), 4)
        assert row["p95"] == round(_percentile(ordered, 0.95), 4)
        assert (row["min"], row["max"]) == (round(ordered[0], 4), round(ordered[-1], 4))
        assert row["pass_rate"] == round(sum(v >= 0.85 for v in values) / len(values), 4)
    plain = agg.metric_percentiles(scores, {"p10": 0.1, "p95": 0.95}).collect()
    for row in plain:
        values = sorted(groups[(row["eval_run_id"], row["metric"])])
        assert row["p95"] == _percentile(values, 0.95) and row["p10"] == pytest.approx(_percentile(values, 0.1), abs=0)


def test_run_actions(spark):
    schema = (
        "eval_run_id string, status string, n_results bigint, total_cases bigint, completed_shards bigint, total_shards bigint, "
        "created_at string, force boolean"
    )
    rows = [
        ("gated", "pass", 0, 4, 0, 1, "2024-01-01T00:00:00Z", False),
        ("forced", "fail", 0, 4, 0, 1, "2024-01-01T00:00:00Z", True),
        ("waiting", "running", 1, 4, 0, 1, "2024-01-01T00:59:00Z", False),
        ("late", "running", 1, 4, 0, 1, "2024-01-01T00:30:00", None),
        ("done", "running", 4, 4, 0, 1, "2024-01-01T00:59:00Z", False),
        ("shards", "pending", 0, 4, 1, 1, "2024-01-01T00:00:00Z", False),
        ("timeout", "timeout", 4, 4, 1, 1, "2024-01-01T00:00:00Z", False),
    ]
    runs = spark.createDataFrame(rows, schema).withColumn("created_at", G.utc_instant(F.col("created_at")))
    got = {r["eval_run_id"]: r for r in G.run_actions(runs, F.lit("2024-01-01 01:00:00").cast("timestamp")).collect()}
    actions = {k: r["action"] for k, r in got.items()}
    assert actions == {
        "gated": "skip", "forced": "aggregate", "waiting": "wait", "late": "aggregate", "done": "aggregate",
        "shards": "aggregate", "timeout": "aggregate",
    }
    assert got["late"]["gate_timed_out"] and not got["shards"]["gate_timed_out"]
    assert {r["eval_run_id"] for r in G.open_runs(runs).collect()} == {"waiting", "late", "done", "shards"}


def test_report_texts_and_outbox(spark):
    rows = [("ok", "c", None, _all((1, 1, 1))), ("bad", "c", None, _all((0.0625, 0.8, 1.0)))]
    report = results_to_reports(_results(spark, rows)).withColumn("judge_model_id", F.lit("judge-a"))
    texts = {r["eval_run_id"]: r["markdown"] for r in rep.markdown(report).collect()}
    assert texts["ok"].startswith("# Evaluation PASS") and "Reasons" not in texts["ok"]
    assert "| faithfulness | 0.062 |" in texts["bad"] and "* overall score 0.621 is below 0.850" in texts["bad"]
    none = F.lit(None).cast("string")
    box = rep.notification_outbox(report, none, none, F.lit(0), F.lit(True), F.lit(True)).collect()
    got = {r["eval_run_id"]: r for r in box}
    assert got["ok"]["chat_skip_reason"] == "gate_passed" and got["bad"]["chat_text"].startswith("Evaluation FAILED for repo at -")
    assert got["bad"]["check_skip_reason"] == "missing_credentials_or_context" and got["bad"]["comment_body"] is None
    known = rep.notification_outbox(report, F.lit("acme/agent"), F.lit("abc"), F.lit(3), F.lit(False), F.lit(True)).collect()
    got = {r["eval_run_id"]: r for r in known}
    assert got["bad"]["chat_skip_reason"] == "missing_webhook" and got["bad"]["check_conclusion"] == "failure"
    assert got["ok"]["comment_body"] == texts["ok"]
