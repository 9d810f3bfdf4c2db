from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from runsieve.operators.aggregate import latest_results
from runsieve.operators.dispatch import assign_shards
from runsieve.plans.evaluate import evaluate_dataset, score_cases
from runsieve.operators.traces import default_traces
from runsieve.session import fresh_dir, shared_dir
from runsieve.sources import golden, results, shards, sinks, triggers


def _dataset():
    text = "A refund is possible within two weeks."
    trace = {"answer": text, "retrieved_contexts": [text], "tool_calls": [{"name": "search_docs", "arguments": {"q": "refund"}}]}
    return {
        "name": "sample",
        "cases": [
            {"id": " one ", "suite": "rag", "query": "refund?", "expected_answer": text, "expected_contexts": [text],
             "expected_tools": ["search_docs"], "recorded_trace": trace, "metadata": {"owner": {"team": "x"}}},
            {"id": "two", "query": "bare", "unknown_field": 1},
        ],
    }


def test_golden_file_to_report(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "sample.json").write_text(json.dumps(_dataset(), indent=2))
    (tmp_path / "notes.txt").write_text("ignored")
    cases = golden.case_rows(golden.read_golden(spark, str(tmp_path)), F.col("name"))
    one, two = cases.orderBy("pos").collect()
    assert (one["case_id"], one["suite"], one["version"], one["pos"]) == ("one", "rag", "1.0", 0)
    assert json.loads(one["metadata"]) == {"owner": {"team": "x"}}
    assert json.loads(one["recorded_trace"]["tool_calls"][0]["arguments"]) == {"q": "refund"}
    assert (two["suite"], two["expected_contexts"], two["recorded_trace"], two["metadata"]) == ("hybrid", [], None, "{}")
    runs = cases.withColumnRenamed("dataset_id", "eval_run_id")
    good = evaluate_dataset(runs.filter("case_id = 'one'")).first()
    assert good["status"] == "pass" and good["overall_score"] == 1.0 and good["passed_cases"] == 1
    bare = score_cases(default_traces(runs)).filter("case_id = 'two'").first()
    assert [m["score"] for m in bare["metrics"]] == [0.0, 0.0, 1.0] and bare["error"] is None and bare["answer"] == ""


def test_written_golden_sets_are_packed(spark, tmp_path):
    """The texts of a case are there several times, but not on disk; plain and packed sets are read together."""
    lines = [f"line {i} of {' '.join(str(i * j % 997) for j in range(60))}" for i in range(400)]
    case = [{"id": f"L{i}", "query": t, "expected_answer": t, "expected_contexts": [t], "recorded_trace": {"answer": t, "retrieved_contexts": [t]}} for i, t in enumerate(lines)]
    sets = spark.createDataFrame([(json.dumps({"name": "big", "cases": case}),)], "body string")
    golden.write_golden(golden.parse_golden(sets, "body").drop("body"), f"{tmp_path}/sets")
    stored = sum(f.stat().st_size for f in (tmp_path / "sets").glob("part-*"))
    assert 0 < stored < sum(map(len, lines))
    (tmp_path / "sets" / "one.json").write_text(json.dumps({"name": "small", "cases": [{"id": "a", "query": "q"}]}))
    rows = golden.case_rows(golden.read_golden(spark, str(tmp_path), whole_files=False), F.col("name")).collect()
    assert sorted((r["pos"], r["query"]) for r in rows if r["dataset_id"] == "big") == list(enumerate(lines))
    assert [r["case_id"] for r in rows if r["dataset_id"] == "small"] == ["a"]


def test_result_documents(spark, tmp_path):
    def result(case, answer):
        return {"eval_run_id": "r", "case_id": case, "shard_id": 0, "suite": "rag", "query": "q", "answer": answer,
                "judge_model_id": "j", "metrics": [{"name": "faithfulness", "score": 0.5, "passed": False}]}

    files = {
        "a.json": [result("1", "old"), result("2", "x")],
        "b.json": result("1", "new"),
        "c.json": {"results": [result("3", "y"), result("3", "z")]},
        "d.json": {"other": []},
        "e.json": [],
    }
    for name, body in files.items():
        (tmp_path / name).write_text(json.dumps(body, indent=1))
    (tmp_path / "f.json").write_text("{broken")
    (tmp_path / "g.txt").write_text(json.dumps([result("9", "no")]))
    documents = results.read_result_documents(spark, str(tmp_path))
    rows = results.parse_result_documents(documents)
    assert rows.count() == 5
    last = {r["case_id"]: r["answer"] for r in latest_results(rows, ["file_path", "pos"]).collect()}
    assert last == {"1": "new", "2": "x", "3": "z"}
    assert [r["file_path"][-6:] for r in results.unreadable_documents(documents).collect()] == ["f.json"]


def test_shard_layout_prunes_and_replaces(spark):
    path = fresh_dir(spark, "layout")
    cases = spark.createDataFrame([(f"r{r}", f"c{i}", i) for r in range(2) for i in range(20)], "eval_run_id string, case_id string, pos bigint")
    sharded = assign_shards(cases, size=8)
    shards.write_shards(sharded, path)
    shards.write_shards(sharded.filter("eval_run_id = 'r0'"), path)  # a rerun of one run keeps the other
    assert shards.read_shards(spark, path).count() == 40
    one = shards.read_shard(spark, path, "r1", 2)
    assert sorted(r["case_id"] for r in one.collect()) == ["c16", "c17", "c18", "c19"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*(run_bucket[^]]*shard_block|shard_block[^]]*run_bucket)", plan) and "EqualTo(shard_id,2)" in plan
    jobs = spark.createDataFrame([("r0", 0), ("r0", 0), ("r1", 1)], "eval_run_id string, shard_id bigint")
    picked = shards.read_shards(spark, path, jobs)
    assert picked.count() == 16
    buckets = {r[0] for r in spark.createDataFrame([("r0",), ("r1",)], "r string").select(shards.run_bucket(F.col("r"))).collect()}
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = picked._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = re.findall(r"PartitionFilters: \[([^\]]*run_bucket[^\]]*)\]", plan)
    assert len(filters) == 2 and all(str(b) in f for b in buckets for f in filters) and any("shard_block" in f for f in filters)
    assert shards.read_shards(spark, path, jobs.limit(0)).count() == 0
    # Cases of a dispatch that broke off before its pointer are not seen.
    late = spark.read.parquet(path).filter("eval_run_id = 'r1'").withColumn("dispatch", F.lit(2**62)).limit(3)
    late.write.mode("append").partitionBy("run_bucket", "shard_block").parquet(path)
    assert shards.read_shards(spark, path).count() == 40 and shards.read_shard(spark, path, "r1", 2).count() == one.count()


def test_shorter_dispatch_and_ids_that_look_like_numbers(spark):
    path = fresh_dir(spark, "redispatch")
    ids = ["007", "1e5"]
    cases = spark.createDataFrame([(r, f"c{i}", i) for r in ids for i in range(9000)], "eval_run_id string, case_id string, pos bigint")
    shards.write_shards(assign_shards(cases, size=1), path)
    shards.write_shards(assign_shards(cases.filter("eval_run_id = '007' AND pos < 10"), size=1), path)
    counts = {r["eval_run_id"]: r["count"] for r in shards.read_shards(spark, path).groupBy("eval_run_id").count().collect()}
    assert counts == {"007": 10, "1e5": 9000}


def test_reports_replace_their_own_run_only(spark):
    path, other = fresh_dir(spark, "reports"), fresh_dir(spark, "compacted")
    schema = "eval_run_id string, report_json string, run_date string"
    for rows in ([("a", "1", "2024-01-01")], [("b", "1", "2024-01-01")], [("a", "2", "2024-01-01")]):
        sinks.write_reports(spark.createDataFrame(rows, schema), path)
    sinks.compact(spark, path, schema, other)
    for at in (path, other):
        assert sorted((r["eval_run_id"], r["report_json"]) for r in sinks.read_reports(spark, at, schema).collect()) == [("a", "2"), ("b", "1")]
    assert spark.read.json(other).count() == 2
    texts = fresh_dir(spark, "markdown")
    for run in ("a", "b", "a"):
        sinks.write_markdown(spark.createDataFrame([(run, f"# {run}\nline")], "eval_run_id string, markdown string"), texts)
    assert sinks.read_markdown(spark, texts).count() == 2


def test_object_keys_with_stray_percent_signs(spark):
    rows = spark.createDataFrame([("50%_off.json",), ("a+b%20c%2Fd",), ("%FF",), (None,)], "k string")
    assert [r[0] for r in rows.select(triggers.decoded_key(F.col("k"))).collect()][:2] == ["50%_off.json", "a b c/d"]


def test_batch_log_is_idempotent(spark):
    path = fresh_dir(spark, "log")
    first = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v bigint")
    second = spark.createDataFrame([("a", 2)], "k string, v bigint")
    assert sinks.read_log(spark, path, first.schema).count() == 0
    for batch, number in ((first, 0), (second, 1), (second, 1), (first, 0)):
        sinks.append_batch(batch, number, path)
    log = sinks.read_log(spark, path, first.schema)
    assert log.count() == 3
    assert {tuple(r) for r in sinks.current_rows(log, ["k"]).collect()} == {("a", 2), ("b", 1)}


def test_shared_folder_comes_from_the_session(spark):
    assert fresh_dir(spark, "x").startswith(shared_dir(spark)) and shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
