from __future__ import annotations

import json

from pyspark.sql import functions as F

from runsieve.plans.dispatch import dispatch_runs
from runsieve.sources.golden import case_rows, parse_golden
from runsieve.sources.state import decode_runs, run_items


def _set(n, suite="rag", name="n"):
    return json.dumps({"name": name, "cases": [{"id": f"c{i}", "suite": suite, "query": "q"} for i in range(n)]})


def test_triggers_to_runs_jobs_and_rejections(spark):
    sets = {"s3://b/good": _set(19), "s3://b/odd": _set(2, "x"), "s3://b/none": _set(0), "s3://b/twice": json.dumps({"cases": [{"id": "a"}, {"id": " a "}]})}
    docs = spark.createDataFrame(list(sets.items()), "uri string, body string")
    events = [
        {"dataset_bucket": "b", "dataset_key": "good", "eval_run_id": "r1", "git_sha": "s1", "pr_number": 4, "repo": "o/r"},
        {"dataset_bucket": "b", "dataset_key": "good", "eval_run_id": "r1", "git_sha": "s1", "pr_number": 4, "repo": "o/r"},
        {"dataset_id": "known", "eval_run_id": "r2", "eval_mode": "online", "agent_endpoint": "http://a"},
        {"Records": [{"s3": {"bucket": {"name": "b"}, "object": {"key": "good"}}}]},
        {"dataset_bucket": "b", "dataset_key": "odd", "eval_run_id": "x1"},
        {"dataset_bucket": "b", "dataset_key": "none", "eval_run_id": "x2"},
        {"dataset_bucket": "b", "dataset_key": "twice", "eval_run_id": "x3"},
        {"dataset_bucket": "b", "dataset_key": "absent", "eval_run_id": "x4"},
        {"eval_run_id": "x5"},
        {"dataset_bucket": "b", "dataset_key": "good", "eval_run_id": "x6", "eval_backend": "magic"},
    ]
    known = spark.createDataFrame([("known", "s3://b/good")], "dataset_id string, s3_uri string")
    parsed = parse_golden(docs, "body")
    out = dispatch_runs(
        spark.createDataFrame([(json.dumps(e),) for e in events], "event string"), known, docs.select(F.col("uri").alias("dataset_id")),
        case_rows(parsed, F.col("uri")), F.lit("2024-01-01 00:00:00").cast("timestamp"), {"judge_model_id": "j", "repo": "d/r"},
    )
    runs = {r["eval_run_id"]: r for r in out["runs"].collect()}
    third = next(k for k in runs if k.startswith("eval-20240101T000000Z-"))
    assert set(runs) == {"r1", "r2", third}
    assert (runs["r1"]["total_cases"], runs["r1"]["total_shards"], runs["r1"]["source"]["pr_number"], runs["r1"]["source"]["repo"]) == (19, 3, 4, "o/r")
    assert (runs["r2"]["eval_mode"], runs["r2"]["dataset_manifest_id"], runs["r2"]["agent_endpoint"], runs["r2"]["source"]["repo"]) == ("online", "known", "http://a", "d/r")
    assert runs[third]["judge_model_id"] == "j" and runs[third]["dataset_manifest_id"] == "n"
    jobs = {(r["eval_run_id"], r["shard_id"]): r for r in out["jobs"].collect()}
    assert len(jobs) == 9 and jobs["r1", 2]["case_ids"] == ["c16", "c17", "c18"] and jobs["r2", 0]["eval_mode"] == "online"
    assert out["cases"].count() == 57
    assert {r["dataset_id"] for r in out["manifests"].collect()} == {"s1", "n"}
    reasons = {r["eval_run_id"]: r["reason"] for r in out["rejected"].collect()}
    assert reasons == {
        "x1": "invalid data set: unknown_suite", "x2": "invalid data set: no_cases", "x3": "invalid data set: duplicate_id",
        "x4": "the data set was not found", "x5": "a dataset key or a known dataset id is required", "x6": "unknown backend magic",
    }
    items = run_items(out["runs"]).select("eval_run_id", "status", "completed_shards", "completed_cases", "payload")
    back = {r["eval_run_id"]: r for r in decode_runs(items).collect()}
    assert back["r1"]["thresholds"]["overall"] == 0.85 and back["r1"]["source"]["git_sha"] == "s1" and back["r2"]["eval_backend"] == "deepeval"


def test_run_ids_tell_triggers_apart(spark):
    docs = spark.createDataFrame([("s3://b/good", _set(19))], "uri string, body string")
    base = {"dataset_bucket": "b", "dataset_key": "good"}
    events = [
        {**base, "candidate_model_id": "A"}, {**base, "candidate_model_id": "B"}, {**base, "candidate_model_id": "B"},
        {**base, "git_sha": "s"}, {**base, "repo": "s"}, {**base, "eval_run_id": "one", "pr_number": 1}, {**base, "eval_run_id": "one", "pr_number": 2},
    ]
    out = dispatch_runs(
        spark.createDataFrame([(json.dumps(e),) for e in events], "event string"), spark.createDataFrame([], "dataset_id string, s3_uri string"),
        docs.select(F.col("uri").alias("dataset_id")), case_rows(parse_golden(docs, "body"), F.col("uri")), F.lit("2024-01-01 00:00:00").cast("timestamp"),
    )
    runs = [r["eval_run_id"] for r in out["runs"].collect()]
    assert len(runs) == len(set(runs)) == 4 and "one" not in runs
    jobs = out["jobs"].groupBy("eval_run_id").agg(F.count("*").alias("n"), F.sum(F.size("case_ids")).alias("c")).collect()
    assert all((r["n"], r["c"]) == (3, 19) for r in jobs) and out["cases"].count() == 4 * 19
    assert [(r["eval_run_id"], r["reason"]) for r in out["rejected"].collect()] == [("one", "other triggers have the same run id")] * 2


def test_cases_of_one_set_spread_over_tasks(spark):
    docs = spark.createDataFrame([("s3://b/big", _set(4000))], "uri string, body string").coalesce(1)
    cases = case_rows(parse_golden(docs, "body"), F.col("uri"))
    assert "hashpartitioning(dataset_id" in cases._jdf.queryExecution().executedPlan().toString()
    assert cases.count() == 4000
