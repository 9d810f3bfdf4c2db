from __future__ import annotations

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from runsieve.operators import scorers, verdicts

# text, score, passed, parsed
REPLIES = [
    ('{"score": 0.8, "passed": true}', 0.8, True, True),
    ('thinking\n```json\n{"score": 0.8, "passed": true}\n```\n', 0.8, True, True),
    ('```JSON {"score": 0.7}```', 0.7, False, True),
    ('prefix {"score": 1} suffix', 1.0, True, True),
    ('{"score": 0.5} trailing', 0.5, False, True),
    ('{"score": 0.9,}', 0.9, True, True),
    ('{"claims": [1,2,], "score": "0.9"}', 0.9, True, True),
    ('[{"score": 0.9}]', 0.9, True, True),
    ('{"a": 1} {"score": 1}', 0.0, False, False),
    ("   ", 0.0, False, False),
    ("", 0.0, False, False),
    ("no object here", 0.0, False, False),
    ('{"score": 2, "passed": "false"}', 1.0, True, True),
    ('{"score": -1, "passed": 0}', 0.0, False, True),
    ('{"score": 1, "passed": []}', 1.0, False, True),
    ('{"score": 1, "passed": {}}', 1.0, False, True),
    ('{"score": 1, "passed": null}', 1.0, False, True),
    ('{"score": true}', 1.0, True, True),
    ('{"score": "x"}', 0.0, False, True),
    ('{"passed": [0]}', 0.0, True, True),
    ("{}", 0.0, False, True),
    ('{"text": "a } brace", "score": 0.9}', 0.9, True, True),
]


def test_reply_shapes(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(REPLIES)], "i int, reply_text string")
    for row in verdicts.judge_verdicts(df).collect():
        text, score, passed, parsed = REPLIES[row["i"]]
        assert (row["score"], row["passed"], row["parsed_ok"]) == (score, passed, parsed), text


def test_reply_fields(spark):
    long = "x" * 3000
    texts = ['{"reasoning": "why", "chain_of_thought": "", "claims": [1, 2], "score": 1}', long]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, reply_text string")
    good, bad = verdicts.judge_verdicts(df).orderBy("i").collect()
    assert (good["reasoning"], good["chain_of_thought"], good["n_claims"]) == ("why", "", 2)
    assert good["raw_keys"] == ["chain_of_thought", "claims", "reasoning", "score"]
    assert bad["chain_of_thought"] == "x" * 2000 and bad["n_claims"] == 0


def test_model_reply_envelope(spark):
    body = {
        "output": {"message": {"content": [{"text": '{"score": 0.91,'}, {"image": "i"}, {"text": '"passed": true}'}]}},
        "usage": {"inputTokens": 120, "outputTokens": 40},
        "stopReason": "end_turn",
    }
    rows = [(json.dumps(body),), ("{}",), ('{"stopReason": "max_tokens"}',)]
    got = verdicts.model_replies(spark.createDataFrame(rows, "body string"))
    first, second, third = verdicts.judge_verdicts(got, threshold=0.7).collect()
    assert (first["score"], first["passed"], first["input_tokens"], first["output_tokens"]) == (0.91, True, 120, 40)
    assert (second["reply_text"], second["input_tokens"], second["unexpected_stop"]) == ("", 0, False)
    assert third["unexpected_stop"]


def test_external_scores_pass_before_rounding(spark):
    df = spark.createDataFrame([("a", 0.84999), ("b", 1.7), ("c", None)], "id string, raw double")
    deep = {r["id"]: (r["score"], r["passed"]) for r in verdicts.external_scores(df, "deepeval", "raw").collect()}
    assert deep == {"a": (0.85, False), "b": (1.0, True), "c": (0.0, False)}
    assert {r["id"] for r in verdicts.external_scores(df, "ragas", "raw").collect()} == {"a", "b"}


@pytest.mark.parametrize(
    ("backend", "judge", "given", "want"),
    [
        ("deepeval", True, ["deepeval", "judge", "heuristic"], "deepeval"),
        ("deepeval", True, ["judge", "heuristic"], "judge"),
        ("ragas", False, ["deepeval", "judge", "heuristic"], "heuristic"),
        ("all", True, ["deepeval", "ragas", "judge", "heuristic"], "judge"),
        ("native", False, ["deepeval", "heuristic"], "heuristic"),
    ],
)
def test_scorer_choice(spark, backend, judge, given, want):
    keys = "eval_run_id string, case_id string, metric string"
    requests = spark.createDataFrame([("r", "c", "m", backend, judge)], f"{keys}, eval_backend string, judge_enabled boolean")
    rows = [("r", "c", "m", g, 0.5, False) for g in given]
    candidates = spark.createDataFrame(rows, f"{keys}, backend string, score double, passed boolean")
    assert verdicts.choose_scores(requests, candidates).first()["backend"] == want


def test_retryable_codes(spark):
    codes = [("ThrottlingException", True), ("MyThrottle", True), ("ReadTimeoutError", True), ("AccessDenied", False)]
    df = verdicts.error_classes(spark.createDataFrame(codes, "code string, want boolean"))
    assert df.filter(F.col("retryable") != F.col("want")).count() == 0


def test_scorer_faults_stay_in_their_row(spark):
    def picky(batch: pd.DataFrame) -> pd.Series:
        if (batch["answer"] == "bad").any():
            raise ValueError("cannot score")
        return batch["answer"].str.len() / 10.0

    scorers.register_scorer("picky", picky)
    df = spark.createDataFrame([("r", "1", "good"), ("r", "2", "bad")], "eval_run_id string, case_id string, answer string")
    rows = {r["case_id"]: r for r in scorers.apply_scorer(df, "picky", "length").collect()}
    assert rows["1"]["score"] == 0.4 and rows["1"]["error"] is None
    assert rows["2"]["score"] is None and rows["2"]["error"] == "ValueError: cannot score"
    assert scorers.apply_scorer(df, "not installed", "length").count() == 0


def test_a_bad_row_costs_few_calls(spark, tmp_path):
    calls = tmp_path / "calls"

    def noted(pdf):
        with calls.open("a") as out:
            out.write("x")
        if "bad" in set(pdf["case_id"]):
            raise ValueError("no")
        return pdf["case_id"].str.len().astype(float)

    scorers.register_scorer("noted", noted)
    scorers.register_scorer("short", lambda pdf: pdf["case_id"].str.len().astype(float).iloc[1:])
    df = spark.createDataFrame([("r", "bad" if i == 700 else f"c{i}") for i in range(1024)], "eval_run_id string, case_id string").coalesce(1)
    rows = scorers.apply_scorer(df, "noted", "length").collect()
    assert [r["case_id"] for r in rows if r["error"]] == ["bad"] and len(rows) == 1024
    assert len(calls.read_text()) <= 2 * 10 + 1
    assert all("scores for 1 rows" in r["error"] for r in scorers.apply_scorer(df.limit(4), "short", "length").collect())
