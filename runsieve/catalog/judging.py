"""Queries on judge requests and replies, external scorers and error rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from runsieve.catalog import views as V
from runsieve.catalog.registry import query
from runsieve.catalog.sql import rnd, with_views
from runsieve.functions.json_text import extract_object, number_or_null
from runsieve.functions.numbers import clamp01
from runsieve.operators import scorers, verdicts
from runsieve.operators.traces import default_traces

RUN = "eval_run_id"


@query(
    "judge_json_extract",
    with_views(
        ["v_judge"],
        """SELECT doc_id, shape < 8 AS found, CASE WHEN shape IN (0, 1, 2) THEN 'claims,passed,reasoning,score' WHEN shape = 3 THEN 'claims,passed,score'
                  WHEN shape IN (4, 5, 7) THEN 'passed,score' WHEN shape = 6 THEN 'reasoning,score' ELSE '' END AS keys FROM v_judge""",
    ),
)
def judge_json_extract(spark, sf):
    df = extract_object(V.judge_replies(spark, sf), "reply_text")
    keys = F.array_join(F.sort_array(F.json_object_keys(F.to_json("parsed"))), ",")
    return df.select("doc_id", F.col("parsed").isNotNull().alias("found"), F.coalesce(keys, F.lit("")).alias("keys"))


@query(
    "clamp_scores",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN least(1.0::DOUBLE, value / 100.0::DOUBLE) WHEN 1 THEN 0.0 WHEN 2 THEN least(1.0::DOUBLE, value)
                  WHEN 3 THEN 0.0 WHEN 4 THEN 1.0 ELSE 0.0 END AS score FROM events""",
)
def clamp_scores(spark, sf):
    kind, value = F.col("event_id") % 6, F.col("value")
    number = F.to_json(F.struct((value / 100.0).alias("score")))
    text = F.concat(F.lit('{"score": " '), value, F.lit(' "}'))
    body = (
        F.when(kind == 0, number)
        .when(kind == 1, F.concat(F.lit('{"score": -'), value, F.lit("}")))
        .when(kind == 2, text)
        .when(kind == 3, F.lit('{"score": "high"}'))
        .when(kind == 4, F.lit('{"score": true}'))
        .otherwise(F.lit('{"score": null}'))
    )
    raw = number_or_null(F.try_variant_get(F.try_parse_json(body), "$.score", "variant"))
    return V.table(spark, sf, "events").select("event_id", clamp01(raw).alias("score"))


@query(
    "judge_verdicts",
    with_views(
        ["v_judge"],
        """SELECT doc_id, shape < 8 AS parsed_ok, CASE WHEN shape = 7 THEN 1.0 WHEN shape < 8 THEN points ELSE 0.0 END AS score,
                  CASE WHEN shape = 5 THEN true WHEN shape = 6 THEN points >= 0.85::DOUBLE WHEN shape < 8 THEN good ELSE false END AS passed,
                  CASE WHEN shape < 3 THEN 'doc ' || doc_id WHEN shape < 8 THEN '' ELSE 'The judge''s reply held no JSON object.' END AS reasoning,
                  CASE WHEN shape = 8 THEN 'no verdict for document ' || doc_id WHEN shape = 9 THEN '  ' || chr(10) || ' ' ELSE '' END AS chain_of_thought,
                  CASE WHEN shape < 3 THEN 1 WHEN shape = 3 THEN 2 ELSE 0 END::BIGINT AS n_claims,
                  CASE WHEN shape IN (0, 1, 2) THEN 'claims,passed,reasoning,score' WHEN shape = 3 THEN 'claims,passed,score'
                       WHEN shape IN (4, 5, 7) THEN 'passed,score' WHEN shape = 6 THEN 'reasoning,score'
                       ELSE 'chain_of_thought,claims,passed,reasoning,score' END AS raw_keys FROM v_judge""",
    ),
)
def judge_verdicts(spark, sf):
    df = verdicts.judge_verdicts(V.judge_replies(spark, sf))
    return df.select(
        "doc_id", "parsed_ok", "score", "passed", "reasoning", "chain_of_thought", "n_claims", F.array_join("raw_keys", ",").alias("raw_keys")
    )


@query(
    "judge_requests",
    with_views(
        ["v_traces"],
        """SELECT eval_run_id, case_id, metric, task || chr(10) || 'Question:' || chr(10) || query || chr(10) || 'Answer:' || chr(10) || answer || chr(10)
                  || 'Context:' || chr(10) || CASE WHEN len(ctx) > 0 THEN array_to_string(ctx, chr(10) || '---' || chr(10)) ELSE '(none)' END || chr(10)
                  || 'Expected answer:' || chr(10) || CASE WHEN expected_answer <> '' THEN expected_answer ELSE '(none)' END AS user_text
           FROM (SELECT *, CASE WHEN len(retrieved_contexts) > 0 THEN retrieved_contexts ELSE expected_contexts END AS ctx FROM v_traces),
                (VALUES ('faithfulness', 'Rate groundedness: the share of the answer''s claims that the context supports (0 without claims). Passing score: 0.90.'),
                        ('answer_relevance', 'Rate relevance: how far the answer settles the question, using the expected answer as a guide. Passing score: 0.85.')) AS t(metric, task)""",
    ),
)
def judge_requests(spark, sf):
    return verdicts.judge_requests(default_traces(V.cases(spark, sf)), {"faithfulness": 0.9})


@query(
    "model_response_norm",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || 'end' ELSE '' END AS reply_text,
              CASE doc_id % 4 WHEN 0 THEN n_chars ELSE 0 END AS input_tokens, CASE doc_id % 4 WHEN 0 THEN doc_id ELSE 0 END AS output_tokens,
              doc_id % 4 = 2 AS unexpected_stop FROM documents""",
)
def model_response_norm(spark, sf):
    kind, text = F.col("doc_id") % 4, F.col("text")

    def blocks(*texts):
        none = F.lit(None).cast("string")
        return F.struct(
            F.struct(F.array(*[F.struct(t.alias("text"), (F.lit("png") if t is texts[0] else none).alias("image")) for t in texts]).alias("content")).alias("message")
        )

    none = F.lit(None).cast("string")
    usage = F.struct(F.col("n_chars").alias("inputTokens"), F.col("doc_id").alias("outputTokens"))
    body = (
        F.when(kind == 0, F.to_json(F.struct(blocks(text).alias("output"), usage.alias("usage"), F.lit("end_turn").alias("stopReason"))))
        .when(kind == 1, F.to_json(F.struct(blocks(text, none, F.lit("end")).alias("output"))))
        .when(kind == 2, F.lit('{"output": {}, "stopReason": "max_tokens"}'))
        .otherwise(F.lit('{"usage": null}'))
    )
    replies = V.table(spark, sf, "documents").select("doc_id", body.alias("body"))
    return verdicts.model_replies(replies).select("doc_id", "reply_text", "input_tokens", "output_tokens", "unexpected_stop")


@query(
    "claim_support",
    with_views(
        ["v_lines"],
        f"""SELECT doc_id, n_claims, n_supported, {rnd('share')} AS support FROM (
              SELECT doc_id, count(*) AS n_claims, count(*) FILTER (supported) AS n_supported, count(*) FILTER (supported) / count(*)::DOUBLE AS share
              FROM (SELECT l.doc_id, coalesce(contains(lower(n.text), lower(l.claim)), false) AS supported
                    FROM (SELECT doc_id, unnest(lines) AS claim FROM v_lines) l LEFT JOIN documents n ON n.doc_id = l.doc_id + 1) GROUP BY 1)""",
    ),
)
def claim_support(spark, sf):
    evidence = V.table(spark, sf, "documents").select((F.col("doc_id") - 1).alias("doc_id"), F.lower("text").alias("evidence"))
    rows = V.doc_lines(spark, sf).select("doc_id", "lines").join(evidence, "doc_id", "left")
    claims = rows.select("doc_id", "evidence", F.explode("lines").alias("claim"))
    found = F.coalesce(F.contains("evidence", F.lower("claim")), F.lit(False))
    return verdicts.claim_support(claims.select("doc_id", found.alias("supported")), ["doc_id"])


@query(
    "external_scores",
    f"""SELECT doc_id, backend, {rnd('b')} AS score, b >= lim AS passed FROM (
          SELECT doc_id, 'deepeval' AS backend, CASE WHEN doc_id % 7 = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, quality * 0.9::DOUBLE + toxic * 0.2::DOUBLE) END AS b, 0.7::DOUBLE AS lim
          FROM labels
          UNION ALL SELECT doc_id, 'ragas', quality * 0.84997::DOUBLE + toxic * 0.1::DOUBLE, 0.85::DOUBLE FROM labels WHERE doc_id % 3 <> 0)""",
)
def external_scores(spark, sf):
    labels = V.table(spark, sf, "labels")
    deep = labels.withColumn("raw", F.when(F.col("doc_id") % 7 != 0, F.col("quality") * 0.9 + F.col("toxic") * 0.2))
    ragas = labels.withColumn("raw", F.when(F.col("doc_id") % 3 != 0, F.col("quality") * 0.84997 + F.col("toxic") * 0.1))
    columns = ["doc_id", "backend", "score", "passed"]
    return (
        verdicts.external_scores(deep, "deepeval", "raw", 0.7).select(*columns)
        .unionByName(verdicts.external_scores(ragas, "ragas", "raw").select(*columns))
    )


@query(
    "scorer_fallback",
    """SELECT CAST(doc_id AS VARCHAR) AS case_id, backend, score, score >= 0.85::DOUBLE AS passed FROM (
         SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND doc_id % 5 <> 0 THEN 'deepeval' WHEN doc_id % 4 = 1 AND doc_id % 7 <> 0 THEN 'ragas'
                             WHEN doc_id % 3 <> 0 THEN 'judge' ELSE 'heuristic' END AS backend,
                CASE WHEN doc_id % 4 = 0 AND doc_id % 5 <> 0 THEN 0.9::DOUBLE * quality WHEN doc_id % 4 = 1 AND doc_id % 7 <> 0 THEN 0.8::DOUBLE * quality
                     WHEN doc_id % 3 <> 0 THEN 0.7::DOUBLE * quality ELSE 0.6::DOUBLE * quality END AS score FROM labels)""",
)
def scorer_fallback(spark, sf):
    d, q = F.col("doc_id"), F.col("quality")
    labels = V.table(spark, sf, "labels").select(
        F.lit("run").alias(RUN), d.cast("string").alias("case_id"), F.lit("faithfulness").alias("metric"), "doc_id", "quality"
    )
    backend = F.when(d % 4 == 0, "deepeval").when(d % 4 == 1, "ragas").when(d % 4 == 2, "native").otherwise("all")
    requests = labels.select(RUN, "case_id", "metric", backend.alias("eval_backend"), (d % 3 != 0).alias("judge_enabled"))
    given = F.array_compact(
        F.array(
            F.when(d % 5 != 0, F.struct(F.lit("deepeval").alias("backend"), (q * 0.9).alias("score"))),
            F.when(d % 7 != 0, F.struct(F.lit("ragas").alias("backend"), (q * 0.8).alias("score"))),
            F.struct(F.lit("judge").alias("backend"), (q * 0.7).alias("score")),
            F.struct(F.lit("heuristic").alias("backend"), (q * 0.6).alias("score")),
        )
    )
    rows = labels.select(RUN, "case_id", "metric", F.explode(given).alias("g")).select(RUN, "case_id", "metric", "g.*")
    chosen = verdicts.choose_scores(requests, rows.withColumn("passed", F.col("score") >= 0.85))
    return chosen.select("case_id", "backend", "score", "passed")


@query(
    "error_classes",
    "SELECT event_id, event_type IN ('click', 'purchase', 'signup') AS retryable FROM events",
)
def error_classes(spark, sf):
    codes = {"click": "ThrottlingException", "view": "ValidationException", "purchase": "SlowTimeoutError", "signup": "RequestThrottled"}
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    code = F.coalesce(F.try_element_at(table, F.col("event_type")), F.lit("AccessDenied"))
    rows = V.table(spark, sf, "events").select("event_id", code.alias("code"))
    return verdicts.error_classes(rows).select("event_id", "retryable")


@query(
    "case_errors",
    """SELECT event_id, '' AS answer, 'AgentError: ' || props AS error, right(repeat(props || ';', 300), 2000) AS traceback,
              0::BIGINT AS n_metrics, 0::BIGINT AS input_tokens, 0::BIGINT AS output_tokens FROM events WHERE event_type = 'error'""",
)
def case_errors(spark, sf):
    failed = V.table(spark, sf, "events").filter(F.col("event_type") == "error").select(
        "event_id", F.lit("AgentError").alias("kind"), "props", F.repeat(F.concat("props", F.lit(";")), F.lit(300)).alias("stack")
    )
    return verdicts.error_results(failed, "kind", "props", "stack").drop("kind", "props", "stack")


def _brevity(batch: pd.DataFrame) -> pd.Series:
    """Example scorer: short answers score high; an empty answer is an error."""
    if (batch["answer"] == "").any():
        raise ValueError("empty answer")
    return (batch["query"].str.len() / batch["answer"].str.len()).clip(upper=1.0)


scorers.register_scorer("brevity", _brevity)


@query(
    "scorer_udf",
    with_views(
        ["v_traces"],
        """SELECT eval_run_id, case_id, 'brevity_score' AS metric, 'brevity' AS backend,
                  CASE WHEN answer <> '' THEN least(1.0::DOUBLE, length(query) / length(answer)::DOUBLE) END AS score,
                  CASE WHEN answer = '' THEN 'ValueError: empty answer' END AS error, answer = '' AS has_traceback FROM v_traces""",
    ),
)
def scorer_udf(spark, sf):
    requests = default_traces(V.cases(spark, sf)).select(RUN, "case_id", "query", "answer")
    scored = scorers.apply_scorer(requests, "brevity", "brevity_score")
    return scored.withColumn("has_traceback", F.col("traceback").isNotNull()).drop("traceback")
