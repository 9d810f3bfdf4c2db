from __future__ import annotations

import json

from pyspark.sql import functions as F

from runsieve.catalog import results as catalog
from runsieve.operators.runs import latest_status
from runsieve.operators.scorers import apply_scorer, register_scorer
from runsieve.operators.traces import normalise_responses
from runsieve.plans.cases import case_results
from runsieve.plans.runs import aggregate_runs, run_outputs, runs_to_gate, stored_results
from runsieve.sources.results import parse_result_documents, read_result_documents
from runsieve.sources.state import decode_runs

_CASE = (
    "eval_run_id string, case_id string, suite string, query string, expected_answer string, expected_contexts array<string>, "
    "expected_tools array<string>, recorded_trace struct<answer:string,retrieved_contexts:array<string>,"
    "tool_calls:array<struct<name:string,arguments:string,result:string>>>, metadata string, eval_mode string, agent_endpoint string, "
    "eval_backend string, judge_enabled boolean, judge_model_id string"
)
_REPLY = "eval_run_id string, case_id string, metric string, body string"
_ADAPTER = "eval_run_id string, case_id string, metric string, backend string, score double, passed boolean"
_NAMES = ("faithfulness", "answer_relevance")


def _body(text, tokens=(3, 2)):
    usage = {"inputTokens": tokens[0], "outputTokens": tokens[1]}
    return json.dumps({"output": {"message": {"content": [{"text": text}]}}, "usage": usage, "stopReason": "end_turn"})


def _cases(spark, **overrides):
    base = {"mode": "offline", "backend": "native", "judged": True, "trace": ("ans", ["ctx"], [("t", "{}", None)])}
    rows = []
    for name, more in overrides.items():
        c = {**base, **more}
        rows.append(("r", name, "rag", "question one", "exp", ["ctx"], ["t"], c["trace"], "{}", c["mode"], None, c["backend"], c["judged"], "j"))
    return spark.createDataFrame(rows, _CASE)


def _run(spark, cases, replies=(), adapters=(), candidates=()):
    live = spark.createDataFrame([], "eval_run_id string, case_id string, answer string, retrieved_contexts array<string>, tool_calls array<struct<name:string,arguments:string,result:string>>")
    got = case_results(
        cases, live, spark.createDataFrame(list(replies), _REPLY), spark.createDataFrame(list(adapters), _ADAPTER),
        spark.createDataFrame(list(candidates), "eval_run_id string, case_id string, body string"),
    )
    return {r["case_id"]: r for r in got.collect()}


def test_judge_adapter_lexical_and_silent_judge(spark):
    cases = _cases(spark, a={}, b={"backend": "deepeval"}, c={"judged": False}, d={}, e={"backend": "all"}, f={"trace": None})
    good = _body('{"score": 0.9, "reasoning": "fine", "claims": [{"claim": "x", "supported": false}, 3]}')
    replies = [("r", c, n, good) for c in "abcef" for n in _NAMES] * 2 + [("r", "d", "faithfulness", good)]
    adapters = [("r", c, n, "deepeval", 0.4, False) for c in "be" for n in _NAMES]
    got = _run(spark, cases, replies, adapters)
    first = {c: got[c]["metrics"][0] if got[c]["metrics"] else None for c in got}
    assert (first["a"]["score"], first["a"]["passed"], first["a"]["judge_model_id"], first["a"]["reasoning"]) == (0.9, True, "j", "fine")
    assert json.loads(first["a"]["details"])["claims"] == [{"claim": "x", "supported": False}, 3]
    assert (got["a"]["input_tokens"], got["a"]["output_tokens"], got["a"]["case_passed"]) == (6, 4, True)
    assert (first["b"]["score"], first["b"]["passed"], got["b"]["input_tokens"]) == (0.4, False, 0)
    assert first["c"]["judge_model_id"] is None and first["c"]["chain_of_thought"] == "lexical scorer"
    assert got["d"]["error"] == "JudgeError: no reply on answer_relevance" and got["d"]["metrics"] == [] and got["d"]["answer"] == ""
    assert first["e"]["score"] == 0.9
    assert got["f"]["error"].startswith("AgentError") and not got["f"]["case_passed"]
    tools = got["a"]["metrics"][2]
    assert json.loads(tools["details"]) == {"expected": ["t"], "actual": ["t"], "precision": 1.0, "recall": 1.0, "f1": 1.0}


def test_run_thresholds_decide_the_judge(spark):
    limits = F.struct(F.lit(0.95).alias("faithfulness"), F.lit(0.5).alias("answer_relevance"))
    cases = _cases(spark, a={}).withColumn("thresholds", limits)
    got = _run(spark, cases, [("r", "a", n, _body('{"score": 0.9}')) for n in _NAMES])
    assert [m["passed"] for m in got["a"]["metrics"][:2]] == [False, True]


def test_candidate_reply_is_stripped_or_replaced(spark):
    cases = _cases(spark, a={"mode": "candidate"}, b={"mode": "candidate"}, c={"mode": "candidate"}).withColumn("judge_enabled", F.lit(False))
    got = _run(spark, cases, candidates=[("r", "a", _body(" said \n")), ("r", "b", _body(" \n "))])
    assert [got[c]["answer"] for c in "abc"] == ["said", "ans", "ans"]


def test_latency_traceback_and_failed_scorers(spark):
    register_scorer("deepeval", lambda pdf: [1 / 0 if c in "bf" else 0.9 for c in pdf["case_id"]])
    requests = spark.createDataFrame([("r", c) for c in "abcf"], "eval_run_id string, case_id string")
    scored = [apply_scorer(requests, "deepeval", n) for n in _NAMES]
    adapters = scored[0].unionByName(scored[1]).withColumn("passed", F.col("score") >= 0.85)
    base = _cases(spark, a={"backend": "deepeval"}, b={"backend": "deepeval"}, c={"mode": "online"}, d={"trace": None}, e={"judged": False}, f={"backend": "all"})
    trace = F.when(F.col("recorded_trace").isNotNull(), F.col("recorded_trace").withField("latency_ms", F.lit(70)))
    cases = base.withColumn("recorded_trace", trace).withColumn("agent_endpoint", F.lit("https://a")).withColumn("judge_enabled", F.col("case_id") == "b")
    live = spark.createDataFrame([("r", "c", '{"answer": "x", "latency_ms": 31}')], "eval_run_id string, case_id string, body string")
    rows = case_results(cases, normalise_responses(live), spark.createDataFrame([], _REPLY), adapters)
    got = {r["case_id"]: r for r in rows.collect()}
    assert {c: got[c]["latency_ms"] for c in "abcde"} == {"a": 70, "b": 70, "c": 31, "d": 0, "e": 70}
    assert got["a"]["metrics"][0]["score"] == 0.9 and got["a"]["error"] is None and got["a"]["metadata"] == "{}"
    assert got["b"]["error"] == "ZeroDivisionError: division by zero" and got["b"]["metrics"] == []
    assert "Traceback" in json.loads(got["b"]["metadata"])["traceback"]
    assert got["d"]["error"].startswith("AgentError") and json.loads(got["d"]["metadata"]) == {"traceback": got["d"]["error"]}
    assert got["f"]["error"] == got["b"]["error"] and got["f"]["latency_ms"] == 70
    assert got["e"]["error"] is None and len(got["e"]["metrics"]) == 3


def _result(run, case, score, error=None):
    metrics = [] if error else [{"name": n, "score": score, "passed": score >= 0.85} for n in (*_NAMES, "tool_selection_precision")]
    return {"eval_run_id": run, "case_id": case, "shard_id": 0, "metrics": metrics, "input_tokens": 10, "output_tokens": 1, "error": error}


def test_stored_runs_to_outputs(spark, tmp_path):
    files = {
        "a/1.json": [_result("a", "1", 0.9), _result("a", "2", 0.2), _result("a", "2", 0.7)],
        "a/2.json": _result("a", "1", 0.9),
        "b/1.json": {"results": [_result("b", "1", 0.9)]},
        "c/1.json": [_result("c", "1", 0.9), _result("c", "2", 0.9, "ToolError: x")],
        "d/1.json": [_result("d", "1", 0.9)],
        "e/1.json": "not a result",
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(content))
    rows = stored_results(parse_result_documents(read_result_documents(spark, str(tmp_path))))
    assert rows.count() == 6
    old, new = "2024-01-01T00:00:00Z", "2024-01-01T11:50:00Z"

    def item(run, total, created, status="running", **more):
        source = {"repo": "o/r", "git_sha": f"sha-{run}", "pr_number": 7}
        return run, None, None, None, json.dumps({"status": status, "total_cases": total, "created_at": created, "source": source, **more})

    items = [
        item("a", 2, new, thresholds={"overall": 0.75}), item("b", 2, old), item("c", 2, new, thresholds={"max_error_rate": 0.5}),
        item("d", 1, new, status="pass"), item("f", 3, old), item("g", 3, new), ("h", None, None, None, None),
    ]
    runs = decode_runs(spark.createDataFrame(items, "eval_run_id string, status string, completed_shards bigint, completed_cases bigint, payload string"))
    as_of = F.lit("2024-01-01 12:00:00").cast("timestamp")
    actions = {r["eval_run_id"]: r["action"] for r in runs_to_gate(rows, runs, as_of).collect()}
    assert actions == {"a": "aggregate", "b": "aggregate", "c": "aggregate", "d": "skip", "f": "aggregate", "g": "wait", "h": "unreadable"}
    reports = aggregate_runs(rows, runs, as_of)
    got = {r["eval_run_id"]: r for r in reports.collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "pass", "b": "fail", "c": "pass", "f": "timeout"}
    assert got["a"]["overall_score"] == 0.8 and got["b"]["failures"] == ["timed out with 1 of 2 cases done"]
    assert (got["c"]["error_cases"], got["c"]["thresholds"]["overall"], got["a"]["thresholds"]["max_error_rate"]) == (1, 0.85, 0.05)
    out = run_outputs(reports, rows, "s3://x", "test", F.lit(True), F.lit(True))
    box = {r["eval_run_id"]: r for r in out["outbox"].collect()}
    assert (box["a"]["check_conclusion"], box["b"]["check_conclusion"], box["b"]["git_sha"], box["b"]["pr_number"]) == ("success", "failure", "sha-b", 7)
    assert out["series"].count() == 4 * 7 and out["markdown"].count() == 4
    audit = {(r["index_name"], r["doc_id"]) for r in out["audit"].collect()}
    assert ("reports", "b") in audit and ("audit", "a:2") in audit and ("cases", "d:1") not in audit
    assert {r["status"] for r in latest_status(out["statuses"], ["updated_at"]).collect()} == {"pass", "fail", "timeout"}
    assert json.loads(out["reports"].filter("eval_run_id = 'a'").first()["report_json"])["overall_score"] == 0.8


def test_result_documents_share_files(spark, tmp_path):
    """Many small runs: documents are read line by line from as many files as tasks wrote, none lost or taken twice."""
    turns = [(c, t, "assistant" if t % 2 else "user", f"turn {t}\r\n of   {c}") for c in range(200) for t in range(2)]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    docs = [(c, f"text {c}\nof a document") for c in range(200)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(c, c % 2, 0) for c in range(0, 200, 2)]
    spark.createDataFrame(labels, "doc_id bigint, quality bigint, toxic bigint").write.parquet(f"{tmp_path}/labels.parquet")
    rows = catalog._stored_rows(spark, str(tmp_path)).collect()
    want = {f"{c}-0" for c in range(200) if not (c % 8 in (3, 4) and c % 3 == 0)}
    assert len(rows) == len(want) and {r["case_id"] for r in rows} == want
    assert len({r["file_path"] for r in rows}) <= 4
