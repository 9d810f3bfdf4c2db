from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from runsieve.operators import inverted, retrieval, traces

_CASE = (
    "eval_run_id string, case_id string, query string, expected_answer string, expected_contexts array<string>, expected_tools array<string>, "
    "recorded_trace struct<answer:string,retrieved_contexts:array<string>,tool_calls:array<struct<name:string,arguments:string,result:string>>>"
)


def _case(spark, *rows):
    base = {"query": "q", "expected_answer": None, "expected_contexts": [], "expected_tools": [], "recorded_trace": None}
    names = ["query", "expected_answer", "expected_contexts", "expected_tools", "recorded_trace"]
    full = [("r", f"c{i}", *[{**base, **row}[n] for n in names]) for i, row in enumerate(rows)]
    return spark.createDataFrame(full, _CASE)


def _ranked(spark, row, k=4):
    return retrieval.rank_case_passages(_case(spark, row), k=k).first()["passages"]


def test_best_passage_first(spark):
    row = {"query": "return window parcels", "expected_contexts": ["Parking rules.", "Parcels: the return window is 30 days."]}
    assert _ranked(spark, row, k=1) == ["Parcels: the return window is 30 days."]


def test_ties_zero_scores_blanks_and_copies(spark):
    trace = ("a", ["two", " one ", "three", "zzz zero"], [])
    row = {"query": "one two", "expected_contexts": [" one", "", "none here", "two\n"], "recorded_trace": trace}
    assert _ranked(spark, row) == ["one", "two", "none here", "three"]
    assert _ranked(spark, {"query": "!?", "expected_contexts": ["b", "a", "c"]}, k=2) == ["b", "a"]
    assert _ranked(spark, {"query": "x"}) == []


def _brute(queries, passages, k):
    def tokens(text):
        return set(re.findall("[a-z0-9]+", text.lower()))

    out = set()
    for qid, q in queries:
        scored = [(-len(tokens(q) & tokens(t)) / math.sqrt(len(tokens(t))), pid) for pid, t in passages if tokens(q) & tokens(t)]
        for rank, (minus, pid) in enumerate(sorted(scored)[:k]):
            out.add((qid, pid, rank + 1, round(-minus, 12)))
    return out


@pytest.mark.parametrize("max_block_tokens", [10_000, 12])
@pytest.mark.parametrize("named", [False, True])
def test_shared_corpus_matches_brute_force(spark, max_block_tokens, named):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]

    def key(i):
        return f"k{i:03d}" if named else i

    # One word occurs in every text, and a third of the passages are copies.
    passages = [(key(i), "the " + " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(80)]
    passages += [(key(80 + i), "the w1 w2") for i in range(40)]
    queries = [(key(i), "The " + " ".join(rng.choices(words, k=4))) for i in range(12)] + [(key(99), "?!")]
    kind = "string" if named else "bigint"
    q = spark.createDataFrame(queries, f"query_id {kind}, query string")
    p = spark.createDataFrame(passages, f"passage_id {kind}, text string").repartition(3)
    got = retrieval.lexical_top_k(q, p, k=4, max_block_tokens=max_block_tokens).collect()
    assert {(r["query_id"], r["passage_id"], r["rank"], round(r["score"], 12)) for r in got} == _brute(queries, passages, 4)


@pytest.mark.parametrize("hot", [10, 100_000])
@pytest.mark.parametrize("named", [False, True])
def test_index_matches_brute_force(spark, tmp_path, hot, named):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]

    def key(i):
        return f"k{i:03d}" if named else i

    passages = [(key(i), "the " + " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(150)]
    passages += [(key(150 + i), "the w1 w2") for i in range(60)] + [(key(300), None), (key(301), ""), (key(302), "rare the")]
    queries = [(key(i), "The " + " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(15)]
    queries += [(key(90), "?!"), (key(91), None), (key(92), "rare"), (key(93), "unseen"), (key(94), "rare the w1")]
    kind = "string" if named else "bigint"
    q = spark.createDataFrame(queries, f"query_id {kind}, query string")
    p = spark.createDataFrame(passages, f"passage_id {kind}, text string").repartition(3)
    index = inverted.build_index(p, str(tmp_path / "index"), hot=hot)
    assert (index.terms.agg(F.max("parts")).first()[0] > 1) == (hot == 10)
    got = inverted.indexed_top_k(inverted.PassageIndex(spark, index.path), q, str(tmp_path / "work")).collect()
    told = {(r["query_id"], r["passage_id"], r["rank"], round(r["score"], 12)) for r in got}
    assert len(got) == len(told) and told == _brute([x for x in queries if x[1]], [x for x in passages if x[1]], 4)


def test_open_requests_skip_bands_and_common_tokens(spark):
    rows = [(1, "a", 8, 2, 1), (1, "b", 8, 50, 1), (1, "the", 8, 9000, 3), (1, "the", 40, 9000, 3), (2, "the", 8, 9000, 3)]
    terms_of = spark.createDataFrame(rows, "query_id int, token string, band int, df long, parts int")
    bands = spark.createDataFrame([(8, 4), (40, 1024)], "band int, least_n int")
    limits = spark.createDataFrame([(1, 1.0)], "query_id int, limit double")
    got = {(r["query_id"], r["token"], r["band"]) for r in inverted.open_requests(terms_of, bands, limits).collect()}
    # Of three tokens two are needed, so one of the two rarest; 1,024 tokens would need 32 of one; query 2 has no limit.
    assert got == {(1, "a", 8), (1, "b", 8), (2, "the", 8)}


def test_index_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "passage_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "passage_id long, text string")
    ask = spark.createDataFrame([(1, "a")], "query_id long, query string")
    assert inverted.indexed_top_k(inverted.build_index(empty, str(tmp_path / "a")), ask, str(tmp_path / "b")).count() == 0
    assert inverted.indexed_top_k(inverted.build_index(some, str(tmp_path / "c")), ask.limit(0), str(tmp_path / "d")).count() == 0


def test_fallback_answer(spark):
    rows = [
        {"recorded_trace": ("rec", [], []), "expected_answer": "exp"},
        {"recorded_trace": ("", [], []), "expected_answer": "exp"},
        {"expected_answer": "", "expected_contexts": ["c" * 600]},
        {},
    ]
    df = _case(spark, *rows)
    answer = traces.fallback_answer(F.col("recorded_trace.answer"), F.col("expected_answer"), F.col("expected_contexts"))
    got = [r[0] for r in df.orderBy("case_id").select(answer).collect()]
    assert got == ["rec", "exp", "c" * 500, traces.NO_CONTEXT_ANSWER]


def test_replayed_calls(spark):
    rows = [
        {"expected_tools": ["x"], "recorded_trace": ("a", [], [("lookup_oncall", "{}", None), ("create_incident", "{}", None)])},
        {"expected_tools": ["search_docs", "rm_rf", "warehouse_query", "create_ticket"], "expected_contexts": ["s" * 300]},
        {"expected_contexts": ["ctx"]},
        {"recorded_trace": ("a", [], []), "expected_contexts": ["ctx"]},
    ]
    got = [r["tool_calls"] for r in traces.replayed_calls(_case(spark, *rows)).orderBy("case_id").collect()]
    assert [c["name"] for c in got[0]] == ["lookup_oncall", "create_incident"]
    assert [(c["name"], c["result"]) for c in got[1]] == [("search_docs", "s" * 280), ("warehouse_query", "0"), ("create_ticket", "ok")]
    assert [c["name"] for c in got[2]] == ["search_docs"]
    assert got[3] == []


def test_resolution_by_mode(spark):
    trace = ("stored", ["ctx"], [("search_docs", "{}", None)])
    cases = _case(spark, {"recorded_trace": trace}, {}, {"expected_answer": "exp"}, {}, {}, {}).withColumn("n", F.substring("case_id", 2, 1).cast("int"))
    mode = F.when(F.col("n") < 2, "offline").when(F.col("n") == 2, "candidate").otherwise("online")
    cases = cases.withColumn("eval_mode", mode).withColumn("agent_endpoint", F.when(F.col("n") != 3, "https://a"))
    body = [("r", "c3", "{}", 200), ("r", "c4", '{"answer": "", "output": "live", "contexts": ["k"]}', 200), ("r", "c5", "{}", 503)]
    replies = spark.createDataFrame(body, "eval_run_id string, case_id string, body string, status_code int")
    got = {r["case_id"]: r for r in traces.resolve_traces(cases, traces.normalise_responses(replies)).collect()}
    assert [got[f"c{i}"]["answer"] for i in range(6)] == ["stored", "", "exp", "", "live", ""]
    assert got["c4"]["retrieved_contexts"] == ["k"] and got["c0"]["tool_names"] == ["search_docs"]
    assert [got[f"c{i}"]["error"] is None for i in range(6)] == [True, False, True, False, True, False]
    assert "503" in got["c5"]["error"]
