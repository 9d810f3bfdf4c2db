from __future__ import annotations

from runsieve.operators import scoring


def _overlaps(case_row, rows):
    df = case_row(*[{"answer": a, "retrieved_contexts": c, "expected_answer": None} for a, c in rows])
    out = scoring.context_overlap(df, "retrieved_contexts", "answer").orderBy("case_id")
    return [r["score"] for r in out.collect()]


def test_context_overlap_branches(case_row):
    rows = [
        ("", ["some context"]),  # the empty string occurs everywhere
        ("  ", []),
        ("text", []),
        ("anything", [""]),
        ("alpha beta", ["alpha beta gamma", "delta", "omega"]),  # one hit of three
        ("alpha beta", ["alpha x", "y"]),  # no hit: token share
        (" ", ["word"]),
    ]
    assert _overlaps(case_row, rows) == [1.0, 0.0, 1.0, 1.0, 0.6 + 0.4 * 1 / 3, 0.5, 0.0]


def test_overlap_compares_eighty_characters(case_row):
    context = "x" * 80 + " differs later"
    assert _overlaps(case_row, [("x" * 80 + " and ends otherwise", [context])]) == [1.0]


def test_faithfulness_prefers_expected_answer_then_retrieved(case_row):
    df = case_row(
        {},
        {"answer": " Thirty days after delivery.\n"},
        {"answer": "unrelated", "retrieved_contexts": [], "expected_contexts": ["unrelated"]},
        {"answer": "word", "expected_answer": "", "retrieved_contexts": ["other"]},
    )
    scores = [r["faithfulness"] for r in scoring.faithfulness(df).orderBy("case_id").collect()]
    assert scores == [1.0, 1.0, 1.0, 0.0]


def test_relevance(case_row):
    df = case_row(
        {},
        {"query": "", "answer": "a"},
        {"query": "a b c", "answer": "a x", "expected_answer": None},  # 2 * 1/3
        {"query": "a b c d e", "answer": "x y", "expected_answer": "x y z"},  # 2/3 from the expected answer
        {"query": "a", "answer": "a", "expected_answer": " "},  # a blank expectation counts as present
    )
    scores = [r["answer_relevance"] for r in scoring.answer_relevance(df).orderBy("case_id").collect()]
    assert scores == [1.0, 0.0, 0.6667, 0.6667, 1.0]


def _tools(case_row, *pairs):
    df = case_row(*[{"expected_tools": e, "tool_names": a} for e, a in pairs])
    return scoring.tool_selection(df, "expected_tools", "tool_names").orderBy("case_id").collect()


def test_tool_selection(case_row):
    rows = _tools(
        case_row,
        (["a"], ["a", "b"]),
        (["a", "b"], ["b", "a"]),
        ([], []),
        (["a"], []),
        ([], ["z"]),
        (["a", " ", "b"], [" a ", "a", "A"]),
    )
    assert [r["tool_selection_precision"] for r in rows] == [0.5, 1.0, 1.0, 0.0, 0.0, 0.5]
    assert [r["tool_recall"] for r in rows] == [1.0, 1.0, 1.0, 0.0, 1.0, 0.5]
    assert rows[0]["tool_f1"] == round(2 / 3, 4)
    assert rows[5]["tool_actual"] == ["a", "a", "A"] and rows[5]["tool_expected"] == ["a", "b"]
    assert rows[0]["tool_reasoning"] == "shared=['a']; extra=['b']"
    assert rows[5]["tool_reasoning"] == "shared=['a']; extra=['A']; not_called=['b']"
    assert rows[3]["tool_reasoning"].endswith("expected ['a']")


def test_tool_log_agrees_with_arrays(spark, case_row):
    pairs = [(["a"], ["a", "b"]), (["a", "b"], ["b", "b"]), ([], ["z"]), (["q"], [])]
    arrays = {r["case_id"]: r["tool_precision"] for r in _tools(case_row, *pairs)}
    expected = spark.createDataFrame([(f"c{i}", t) for i, (e, _) in enumerate(pairs) for t in e], "case_id string, tool string")
    calls = spark.createDataFrame([(f"c{i}", t) for i, (_, a) in enumerate(pairs) for t in a], "case_id string, tool string")
    log = scoring.tool_selection_from_log(expected, calls, ["case_id"]).collect()
    assert {r["case_id"]: r["tool_precision"] for r in log} == arrays


def test_metric_array_order(case_row):
    row = scoring.metric_array(scoring.score_traces(case_row())).first()
    assert [m["name"] for m in row["metrics"]] == ["faithfulness", "answer_relevance", "tool_selection_precision"]
    assert all(m["passed"] and m["score"] == 1.0 for m in row["metrics"])
