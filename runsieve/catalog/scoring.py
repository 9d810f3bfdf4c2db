"""Queries on text functions, scorers, traces and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from runsieve.catalog import views as V
from runsieve.catalog.registry import ORACLES, query
from runsieve.catalog.sql import VIEWS, alnum, fixed, rnd, shared, strip, with_views, words
from runsieve.functions.arrays import explode_once
from runsieve.functions.text import alnum_tokens, shared_count, ws_tokens
from runsieve.operators import retrieval, scoring, traces
from runsieve.operators.inverted import build_index, indexed_top_k
from runsieve.plans.evaluate import score_cases
from runsieve.schemas import PASS_CUTOFF
from runsieve.session import fresh_dir

_NONE = "CAST([] AS VARCHAR[])"


def _text(arr: str):
    return F.array_join(arr, "|")


@query(
    "token_sets",
    f"""SELECT doc_id, len(t) AS n_tokens, array_to_string(list_sort(t), '|') AS tokens
        FROM (SELECT doc_id, {words('text')} AS t FROM documents)""",
)
def token_sets(spark, sf):
    t = V.texts(spark, sf, "documents").select("doc_id", ws_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), _text(F.array_sort("t")).alias("tokens"))


@query(
    "alnum_tokens",
    f"""SELECT page_id, len(t) AS n_tokens, array_to_string(list_sort(t), '|') AS tokens
        FROM (SELECT page_id, {alnum('html')} AS t FROM pages)""",
)
def alnum_token_sets(spark, sf):
    t = V.texts(spark, sf, "pages").select("page_id", alnum_tokens(F.col("html")).alias("t"))
    return t.select("page_id", F.size("t").cast("bigint").alias("n_tokens"), _text(F.array_sort("t")).alias("tokens"))


@query(
    "token_overlap",
    with_views(
        ["v_cases"],
        f"""SELECT case_id, {shared('q', 'a')} AS shared, len(q) AS n_query, len(a) AS n_answer
            FROM (SELECT case_id, {words('query')} AS q, {words("coalesce(reply, '')")} AS a FROM v_cases)""",
    ),
)
def token_overlap(spark, sf):
    answer = F.coalesce("recorded_trace.answer", F.lit(""))
    t = V.cases(spark, sf).select("case_id", ws_tokens(F.col("query")).alias("q"), ws_tokens(answer).alias("a"))
    return t.select(
        "case_id",
        shared_count(F.col("q"), F.col("a")).cast("bigint").alias("shared"),
        F.size("q").cast("bigint").alias("n_query"),
        F.size("a").cast("bigint").alias("n_answer"),
    )


def _dry_run(spark, sf):
    return traces.default_traces(V.cases(spark, sf))


@query(
    "context_overlap",
    with_views(["v_scored"], "SELECT eval_run_id, case_id, overlap AS score, answer = '' AS empty_answer FROM v_scored"),
)
def context_overlap(spark, sf):
    df = _dry_run(spark, sf).withColumn(
        "ctx", F.when(F.size("retrieved_contexts") > 0, F.col("retrieved_contexts")).otherwise(F.col("expected_contexts"))
    )
    return scoring.context_overlap(df, "ctx", "answer").select("eval_run_id", "case_id", "score", "empty_answer")


def _passed(name: str) -> str:
    return f"SELECT eval_run_id, case_id, {name} AS score, {name} >= 0.85::DOUBLE AS passed FROM v_metrics"


@query("heuristic_faithfulness", with_views(["v_metrics"], _passed("faithfulness")))
def heuristic_faithfulness(spark, sf):
    df = scoring.faithfulness(_dry_run(spark, sf))
    score = F.col("faithfulness")
    return df.select("eval_run_id", "case_id", score.alias("score"), (score >= PASS_CUTOFF).alias("passed"))


@query("heuristic_relevance", with_views(["v_metrics"], _passed("answer_relevance")))
def heuristic_relevance(spark, sf):
    df = scoring.answer_relevance(_dry_run(spark, sf))
    score = F.col("answer_relevance")
    return df.select("eval_run_id", "case_id", score.alias("score"), (score >= PASS_CUTOFF).alias("passed"))


_TOOL_SETS = {
    "named": f"""
        SELECT doc_id, list_filter(list_transform(expected_tools, lambda x: {strip('x')}), lambda x: x <> '') AS e,
               list_filter(list_transform(tool_names, lambda x: {strip('x')}), lambda x: x <> '') AS a FROM v_doc_tools""",
    "sized": f"""
        SELECT *, len(list_distinct(e)) AS ne, len(list_distinct(a)) AS na, {shared('e', 'a')} AS nb FROM named""",
    "ratios": """
        SELECT *, CASE WHEN ne = 0 AND na = 0 THEN 1.0::DOUBLE WHEN ne = 0 OR na = 0 THEN 0.0::DOUBLE ELSE nb / na::DOUBLE END AS p,
               CASE WHEN ne = 0 THEN 1.0::DOUBLE WHEN na = 0 THEN 0.0::DOUBLE ELSE nb / ne::DOUBLE END AS r FROM sized""",
    "f1s": "SELECT *, CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END AS f FROM ratios",
}


@query(
    "tool_selection",
    with_views(
        ["v_doc_tools"],
        f"""SELECT doc_id, {rnd('p')} AS tool_precision, {rnd('r')} AS tool_recall, {rnd('f')} AS tool_f1,
                   {rnd('p')} >= 0.85::DOUBLE AS passed, len(e) AS n_expected_names, len(a) AS n_actual_names,
                   'recall=' || {fixed('r', 3)} || ' f1=' || {fixed('f', 3)} AS tool_thought FROM f1s""",
        _TOOL_SETS,
    ),
)
def tool_selection(spark, sf):
    df = scoring.tool_selection(V.doc_tools(spark, sf), "expected_tools", "tool_names")
    return df.select(
        "doc_id",
        "tool_precision",
        "tool_recall",
        "tool_f1",
        (F.col("tool_selection_precision") >= PASS_CUTOFF).alias("passed"),
        F.size("tool_expected").cast("bigint").alias("n_expected_names"),
        F.size("tool_actual").cast("bigint").alias("n_actual_names"),
        "tool_thought",
    )


def _quoted(x: str) -> str:
    esc = (
        "replace(replace(replace(replace(n, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
    )
    one = (
        f"CASE WHEN contains(n, '''') AND NOT contains(n, '\"') THEN '\"' || {esc} || '\"' "
        f"ELSE '''' || replace({esc}, '''', '\\''') || '''' END"
    )
    return f"('[' || array_to_string(list_transform({x}, lambda n: {one}), ', ') || ']')"


@query(
    "tool_reasoning",
    with_views(
        ["v_doc_tools"],
        f"""SELECT doc_id, CASE WHEN ne = 0 AND na = 0 THEN 'no tool was expected or called'
                   WHEN na = 0 THEN 'no tool was called; expected ' || {_quoted('es')}
                   WHEN ne = 0 THEN 'no tool was expected; called ' || {_quoted('acs')}
                   ELSE 'shared=' || {_quoted('common')}
                        || CASE WHEN len(extra) > 0 THEN '; extra=' || {_quoted('extra')} ELSE '' END
                        || CASE WHEN len(miss) > 0 THEN '; not_called=' || {_quoted('miss')} ELSE '' END END AS reasoning
            FROM lists""",
        {
            **_TOOL_SETS,
            "lists": """
              SELECT *, list_sort(list_distinct(e)) AS es, list_sort(list_distinct(a)) AS acs, list_sort(list_intersect(e, a)) AS common,
                     list_sort(list_filter(list_distinct(a), lambda x: NOT list_contains(e, x))) AS extra,
                     list_sort(list_filter(list_distinct(e), lambda x: NOT list_contains(a, x))) AS miss FROM f1s""",
        },
    ),
)
def tool_reasoning(spark, sf):
    df = scoring.tool_selection(V.doc_tools(spark, sf), "expected_tools", "tool_names")
    return df.select("doc_id", F.col("tool_reasoning").alias("reasoning"))


_NOON = {
    "named": """
        SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type AS tool, hour(ts) < 12 AS planned FROM events""",
    "per_tool": """
        SELECT user_id, day, tool, max(CASE WHEN planned THEN 1 ELSE 0 END) AS e, max(CASE WHEN planned THEN 0 ELSE 1 END) AS a
        FROM named GROUP BY 1, 2, 3""",
    "sized": """
        SELECT user_id, day, CAST(sum(e) AS BIGINT) AS ne, CAST(sum(a) AS BIGINT) AS na, CAST(sum(e * a) AS BIGINT) AS nb
        FROM per_tool GROUP BY 1, 2""",
    "ratios": _TOOL_SETS["ratios"],
    "f1s": _TOOL_SETS["f1s"],
}


@query(
    "tool_set_ops",
    with_views(
        [],
        f"""SELECT user_id, day, ne AS n_expected, na AS n_actual, nb AS n_both,
                   {rnd('p')} AS tool_precision, {rnd('r')} AS tool_recall, {rnd('f')} AS tool_f1 FROM f1s""",
        _NOON,
    ),
)
def tool_set_ops(spark, sf):
    ev = V.table(spark, sf, "events").select(
        "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("tool"), F.hour("ts").alias("h")
    )
    return scoring.tool_selection_from_log(ev.filter("h < 12"), ev.filter("h >= 12"), ["user_id", "day"])


_ALLOWED = ", ".join(f"'{t}'" for t in ("click", "view", "purchase", "signup"))


@query("tools_allowlisted", f"SELECT event_id, user_id, event_type AS tool FROM events WHERE event_type IN ({_ALLOWED})")
def tools_allowlisted(spark, sf):
    allowed = spark.createDataFrame([("click",), ("view",), ("purchase",), ("signup",)], "tool string")
    calls = V.table(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("tool"))
    return calls.join(F.broadcast(allowed), "tool", "left_semi")


_CORPUS = {
    "merged": """SELECT doc_id, list_concat(lines, list_reverse(lines)) AS c, coalesce(lines[len(lines)], '') AS query FROM v_lines""",
    "numbered": """SELECT doc_id, query, unnest(c) AS passage, generate_subscripts(c, 1) AS i FROM merged""",
    "firsts": """SELECT doc_id, query, passage, min(i) AS i FROM numbered GROUP BY 1, 2, 3""",
}


def _line_cases(spark, sf):
    """Documents as cases: query = last line, corpus = the lines, then the lines backwards."""
    lines = V.doc_lines(spark, sf)
    return lines.select(
        "doc_id",
        F.coalesce(F.get("lines", F.size("lines") - 1), F.lit("")).alias("query"),
        F.col("lines").alias("expected_contexts"),
        F.struct(F.reverse("lines").alias("retrieved_contexts")).alias("recorded_trace"),
    )


@query(
    "corpus_dedup",
    with_views(
        ["v_lines"],
        """SELECT doc_id, count(*) AS n_passages, string_agg(passage, chr(10) ORDER BY i) AS passages
           FROM firsts GROUP BY 1""",
        _CORPUS,
    ),
)
def corpus_dedup(spark, sf):
    df = _line_cases(spark, sf)
    merged = df.select(
        "doc_id",
        retrieval.merged_corpus(F.col("expected_contexts"), F.col("recorded_trace.retrieved_contexts")).alias("c"),
    )
    return merged.filter(F.size("c") > 0).select(
        "doc_id", F.size("c").cast("bigint").alias("n_passages"), F.array_join("c", "\n").alias("passages")
    )


@query(
    "rag_retrieve_case",
    with_views(
        ["v_lines"],
        """SELECT doc_id, rank, passage FROM (
             SELECT doc_id, passage, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS rank FROM scored)
           WHERE rank <= 4""",
        {
            **_CORPUS,
            "tokened": f"""SELECT doc_id, i, passage, {alnum('query')} AS q, {alnum('passage')} AS p FROM firsts""",
            "scored": f"""SELECT doc_id, i, passage, CASE WHEN len(q) = 0 OR len(p) = 0 THEN 0.0::DOUBLE
                          ELSE {shared('q', 'p')} / sqrt(len(p)::DOUBLE) END AS score FROM tokened""",
        },
    ),
)
def rag_retrieve_case(spark, sf):
    ranked = retrieval.rank_case_passages(_line_cases(spark, sf), k=4)
    rows = explode_once(ranked.select("doc_id", "passages"), "passages", "passage", "i")
    return rows.select("doc_id", (F.col("i") + 1).alias("rank"), "passage")


@query(
    "lexical_topk",
    with_views(
        [],
        f"""SELECT query_id, passage_id, score, rank FROM (
              SELECT query_id, passage_id, score,
                     row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM scored)
            WHERE rank <= 4""",
        {
            "q": f"SELECT item_id AS query_id, unnest({alnum('text')}) AS token FROM benchmark",
            "p": f"SELECT doc_id AS passage_id, {alnum('text')} AS tokens FROM documents",
            "postings": "SELECT passage_id, len(tokens) AS n, unnest(tokens) AS token FROM p",
            "scored": """SELECT query_id, passage_id, count(*) / sqrt(n::DOUBLE) AS score
                         FROM q JOIN postings USING (token) GROUP BY query_id, passage_id, n""",
        },
    ),
)
def lexical_topk(spark, sf):
    queries = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    passages = V.texts(spark, sf, "documents").select(F.col("doc_id").alias("passage_id"), "text")
    return retrieval.lexical_top_k(queries, passages, k=4).withColumn("rank", F.col("rank").cast("bigint"))


@query("indexed_topk", ORACLES["lexical_topk"])
def indexed_topk(spark, sf):
    """The same passages as ``lexical_topk``, from a stored inverted index."""
    queries = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    passages = V.texts(spark, sf, "documents").select(F.col("doc_id").alias("passage_id"), "text")
    index = build_index(passages, fresh_dir(spark, "passage-index"))
    return indexed_top_k(index, queries, fresh_dir(spark, "top-k")).withColumn("rank", F.col("rank").cast("bigint"))


_RANKED = {
    "merged": f"""
        SELECT eval_run_id, case_id, query,
               list_filter(list_transform(list_concat(expected_contexts, CASE WHEN reply IS NULL THEN {_NONE} ELSE retrieved_contexts END),
                                          lambda x: {strip('x')}), lambda x: x <> '') AS c
        FROM v_called""",
    "numbered": "SELECT eval_run_id, case_id, query, unnest(c) AS passage, generate_subscripts(c, 1) AS i FROM merged",
    "firsts": "SELECT eval_run_id, case_id, query, passage, min(i) AS i FROM numbered GROUP BY 1, 2, 3, 4",
    "tokened": f"SELECT eval_run_id, case_id, i, passage, {alnum('query')} AS q, {alnum('passage')} AS p FROM firsts",
    "pscored": f"""SELECT eval_run_id, case_id, i, passage, CASE WHEN len(q) = 0 OR len(p) = 0 THEN 0.0::DOUBLE
                   ELSE {shared('q', 'p')} / sqrt(len(p)::DOUBLE) END AS score FROM tokened""",
    "ranked": """SELECT eval_run_id, case_id, list(passage ORDER BY rank) AS ctx FROM (
                   SELECT *, row_number() OVER (PARTITION BY eval_run_id, case_id ORDER BY score DESC, i) AS rank FROM pscored)
                 WHERE rank <= 4 GROUP BY 1, 2""",
    "based": f"SELECT c.*, coalesce(r.ctx, {_NONE}) AS ctx FROM v_called c LEFT JOIN ranked r USING (eval_run_id, case_id)",
    "fallen": """
        SELECT *, CASE WHEN reply <> '' THEN reply WHEN expected_answer <> '' THEN expected_answer
                       WHEN len(ctx) > 0 THEN substr(ctx[1], 1, 500) ELSE 'Nothing was retrieved for this question.' END AS fallback
        FROM based""",
    "planned": f"""
        SELECT *, CASE WHEN len(tool_names) > 0 THEN tool_names
                  ELSE list_filter(CASE WHEN len(expected_tools) > 0 THEN expected_tools WHEN reply IS NOT NULL THEN tool_names
                       WHEN len(expected_contexts) > 0 THEN ['search_docs'] ELSE {_NONE} END,
                       lambda x: list_contains(['search_docs', 'lookup_oncall', 'create_incident', 'create_ticket', 'warehouse_query'], x)) END AS calls
        FROM fallen""",
    "resolved": f"""
        SELECT *, CASE WHEN eval_mode = 'offline' AND reply IS NULL THEN 'AgentError: no recorded trace for ' || case_id
                       WHEN eval_mode = 'online' AND NOT has_endpoint THEN 'AgentError: no endpoint is set'
                       WHEN eval_mode = 'online' AND live_answer IS NULL THEN 'AgentError: no reply' END AS error
        FROM planned""",
    "traced": f"""
        SELECT *, CASE WHEN error IS NOT NULL THEN '' WHEN eval_mode = 'offline' THEN reply WHEN eval_mode = 'candidate' THEN fallback
                       ELSE live_answer END AS answer,
               CASE WHEN error IS NOT NULL THEN {_NONE} WHEN eval_mode = 'offline' THEN retrieved_contexts
                    WHEN eval_mode = 'candidate' THEN ctx ELSE expected_contexts END AS got_contexts,
               CASE WHEN error IS NOT NULL THEN {_NONE} WHEN eval_mode = 'offline' THEN tool_names
                    WHEN eval_mode = 'candidate' THEN calls ELSE {_NONE} END AS got_tools
        FROM resolved""",
}


@query(
    "fallback_answer",
    with_views(["v_called"], "SELECT eval_run_id, case_id, fallback AS answer FROM fallen", dict(list(_RANKED.items())[:8])),
)
def fallback_answer(spark, sf):
    ranked = retrieval.rank_case_passages(V.cases(spark, sf), out="ctx")
    answer = traces.fallback_answer(F.col("recorded_trace.answer"), F.col("expected_answer"), F.col("ctx"))
    return ranked.select("eval_run_id", "case_id", answer.alias("answer"))


@query(
    "planned_tools",
    with_views(
        ["v_called"],
        """SELECT eval_run_id, case_id, array_to_string(calls, '|') AS tools, len(calls) AS n_calls FROM planned""",
        dict(list(_RANKED.items())[:9]),
    ),
)
def planned_tools(spark, sf):
    log = traces.replayed_calls(V.cases(spark, sf))
    return log.select(
        "eval_run_id",
        "case_id",
        F.array_join(F.transform("tool_calls", lambda c: c["name"]), "|").alias("tools"),
        F.size("tool_calls").cast("bigint").alias("n_calls"),
    )


def _resolved(spark, sf):
    base = V.cases(spark, sf)
    return traces.resolve_traces(base, V.live_responses(base))


@query(
    "resolve_trace",
    with_views(
        ["v_called"],
        """SELECT eval_run_id, case_id, eval_mode, answer, array_to_string(got_contexts, '~') AS contexts,
                  array_to_string(got_tools, '|') AS tools, coalesce(error, '') AS error FROM traced""",
        _RANKED,
    ),
)
def resolve_trace(spark, sf):
    return _resolved(spark, sf).select(
        "eval_run_id",
        "case_id",
        "eval_mode",
        "answer",
        F.array_join("retrieved_contexts", "~").alias("contexts"),
        F.array_join("tool_names", "|").alias("tools"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


def worker_views() -> dict[str, str]:
    """The default-trace scoring steps applied to the traces resolved by mode."""
    steps = dict(_RANKED)
    steps["w_traces"] = """
        SELECT eval_run_id, case_id, query, expected_answer, expected_contexts, expected_tools, error, answer,
               got_tools AS tool_names, got_contexts AS retrieved_contexts FROM traced"""
    for name in ("tokens", "hits", "shares", "scored", "metrics"):
        text = VIEWS[f"v_{name}"][1]
        for used in ("traces", "tokens", "hits", "shares", "scored"):
            text = text.replace(f"v_{used}", f"w_{used}")
        steps[f"w_{name}"] = text
    return steps


@query(
    "evaluate_cases",
    with_views(
        ["v_called"],
        """SELECT eval_run_id, case_id, CASE WHEN error IS NULL THEN faithfulness END AS faithfulness,
                  CASE WHEN error IS NULL THEN answer_relevance END AS answer_relevance,
                  CASE WHEN error IS NULL THEN tool_selection_precision END AS tool_selection_precision,
                  CASE WHEN error IS NULL THEN 3 ELSE 0 END::BIGINT AS n_metrics, error IS NOT NULL AS has_error,
                  error IS NULL AND faithfulness >= 0.85::DOUBLE AND answer_relevance >= 0.85::DOUBLE
                  AND tool_selection_precision >= 0.85::DOUBLE AS case_passed
           FROM w_metrics""",
        worker_views(),
    ),
)
def evaluate_cases(spark, sf):
    results = score_cases(_resolved(spark, sf))
    return results.select(
        "eval_run_id",
        "case_id",
        *[_score_of(n).alias(n) for n in _NAMES],
        F.size("metrics").cast("bigint").alias("n_metrics"),
        "has_error",
        "case_passed",
    )


def _score_of(name: str):
    return F.get(F.filter("metrics", lambda m: m["name"] == name), 0)["score"]


_NAMES = ("faithfulness", "answer_relevance", "tool_selection_precision")


@query(
    "agent_response_norm",
    r"""SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN '' ELSE text END AS answer,
               CASE doc_id % 5 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END::BIGINT AS n_contexts,
               CASE WHEN doc_id % 5 = 0 THEN n_chars ELSE 0 END AS latency_ms, 0::BIGINT AS n_calls FROM documents""",
)
def agent_response_norm(spark, sf):
    kind, text = F.col("doc_id") % 5, F.col("text")
    body = (
        F.when(kind == 0, F.to_json(F.struct(text.alias("answer"), F.col("n_chars").alias("latency_ms"))))
        .when(kind == 1, F.to_json(F.struct(F.lit("").alias("answer"), text.alias("output"))))
        .when(
            kind == 2,
            F.to_json(
                F.struct(
                    text.alias("answer"), F.lit("other").alias("output"), F.array().cast("array<string>").alias("retrieved_contexts"),
                    F.array(text).alias("contexts"),
                )
            ),
        )
        .when(kind == 3, F.to_json(F.struct(text.alias("output"), F.array(text).alias("retrieved_contexts"))))
        .otherwise(F.lit('{"answer":null,"tool_calls":null}'))
    )
    docs = V.texts(spark, sf, "documents").select("doc_id", body.alias("body"))
    return traces.normalise_responses(docs).select(
        "doc_id",
        "answer",
        F.size("retrieved_contexts").cast("bigint").alias("n_contexts"),
        "latency_ms",
        F.size("tool_calls").cast("bigint").alias("n_calls"),
    )


@query(
    "agent_requests",
    with_views(["v_cases"], "SELECT eval_run_id, case_id, query, '{}' AS metadata FROM v_cases"),
)
def agent_requests(spark, sf):
    sent = traces.agent_requests(V.cases(spark, sf))
    p = F.from_json("body", "case_id string, query string, metadata string")
    return sent.select("eval_run_id", p.alias("p")).select("eval_run_id", "p.*")


@query(
    "candidate_requests",
    with_views(
        ["v_called"],
        """SELECT eval_run_id, case_id, len(ctx) AS n_passages,
                  'Question:' || chr(10) || query || chr(10) || 'Passages:' || chr(10) ||
                  CASE WHEN len(ctx) > 0 THEN array_to_string(ctx, chr(10) || '---' || chr(10)) ELSE '(none)' END AS user_text
           FROM based""",
        dict(list(_RANKED.items())[:7]),
    ),
)
def candidate_requests(spark, sf):
    return traces.candidate_requests(V.cases(spark, sf))
