"""Judge requests and replies, external scores, choice of scorer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsieve.functions.json_text import extract_object, number_or_null, text_or_empty, truthy
from runsieve.functions.numbers import clamp01, round_exact
from runsieve.functions.text import n_items, or_arr, or_str
from runsieve.schemas import METRICS, PASS_CUTOFF

# Error codes that are retried, stop reasons that are expected.
RETRYABLE_CODES = (
    "ThrottlingException",
    "ServiceUnavailableException",
    "ModelTimeoutException",
    "InternalServerException",
    "ModelNotReadyException",
)
EXPECTED_STOPS = ("end_turn", "stop_sequence")

_RUBRICS = {
    METRICS[0]: "Rate groundedness: the share of the answer's claims that the context supports (0 without claims).",
    METRICS[1]: "Rate relevance: how far the answer settles the question, using the expected answer as a guide.",
}
TRACE_CHARS = 2000


def _limit(value: float) -> str:
    """A limit with at least two decimals, and with all it has."""
    short = f"{value:.2f}"
    return short if float(short) == value else repr(float(value))


def judge_requests(traces: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Two request rows per scored case: instruction and evidence as one text."""
    limits = {name: (thresholds or {}).get(name, PASS_CUTOFF) for name in _RUBRICS}
    rubric = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), F.lit(f"{text} Passing score: {_limit(limits[name])}.").alias("task"))
            for name, text in _RUBRICS.items()
        ]
    )
    contexts = or_arr(F.col("retrieved_contexts"), F.col("expected_contexts"))
    evidence = F.concat_ws(
        "\n",
        F.lit("Question:"),
        F.col("query"),
        F.lit("Answer:"),
        F.col("answer"),
        F.lit("Context:"),
        F.coalesce(F.array_join(contexts, "\n---\n"), F.lit("(none)")),
        F.lit("Expected answer:"),
        F.coalesce(or_str(F.col("expected_answer")), F.lit("(none)")),
    )
    rows = traces.select("eval_run_id", "case_id", evidence.alias("_evidence"), F.explode(rubric).alias("_r"))
    return rows.select(
        "eval_run_id", "case_id", "_r.metric", F.concat_ws("\n", F.col("_r.task"), F.col("_evidence")).alias("user_text")
    )


def model_replies(df: DataFrame, body: str = "body") -> DataFrame:
    """Add reply_text, input_tokens, output_tokens, stop_reason, unexpected_stop."""
    shape = (
        "output struct<message:struct<content:array<struct<text:string>>>>, "
        "usage struct<inputTokens:bigint,outputTokens:bigint>, stopReason string"
    )
    r = F.col("_m")
    texts = F.filter(F.transform(r["output"]["message"]["content"], lambda b: b["text"]), lambda t: t.isNotNull())
    return (
        df.withColumn("_m", F.from_json(body, shape))
        .withColumn("reply_text", F.coalesce(F.array_join(texts, "\n"), F.lit("")))
        .withColumn("input_tokens", F.coalesce(r["usage"]["inputTokens"], F.lit(0)))
        .withColumn("output_tokens", F.coalesce(r["usage"]["outputTokens"], F.lit(0)))
        .withColumn("stop_reason", r["stopReason"])
        .withColumn("unexpected_stop", F.coalesce(~F.col("stop_reason").isin(*EXPECTED_STOPS), F.lit(False)))
        .drop("_m")
    )


def judge_verdicts(replies: DataFrame, text: str = "reply_text", threshold: Column | float = PASS_CUTOFF) -> DataFrame:
    """Add score, passed, reasoning, chain_of_thought, claims, n_claims, raw_keys, details, parsed_ok.

    ``passed`` is the truth of the field when the reply has it (the string
    "false" is true), else score >= threshold. Unreadable replies score 0 and
    keep the start of the text as their chain of thought. ``claims`` holds the
    claims that are objects; ``details`` is JSON with all of them and the keys. With
    a NULL threshold ``passed`` is NULL where the reply does not say it.
    """
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    p = F.col("_parsed")

    def field(name: str) -> Column:
        return F.try_variant_get(p, f"$.{name}", "variant")

    keys = F.coalesce(F.sort_array(F.json_object_keys(F.to_json(p))), F.array().cast("array<string>"))
    ok = p.isNotNull()
    return (
        extract_object(replies, text, "_parsed")
        .withColumn("parsed_ok", ok)
        .withColumn("raw_keys", F.when(ok, keys).otherwise(F.array(*[F.lit(k) for k in _FAILED_KEYS])))
        .withColumn("score", F.when(ok, clamp01(number_or_null(field("score")))).otherwise(F.lit(0.0)))
        .withColumn(
            "passed",
            F.when(~ok, F.lit(False))
            .when(F.array_contains("raw_keys", "passed"), truthy(field("passed")))
            .otherwise(F.col("score") >= limit),
        )
        .withColumn("reasoning", F.when(ok, text_or_empty(field("reasoning"))).otherwise(F.lit(_NOT_JSON)))
        .withColumn(
            "chain_of_thought",
            F.when(ok, text_or_empty(field("chain_of_thought"))).otherwise(F.substring(F.col(text), 1, TRACE_CHARS)),
        )
        .withColumn(
            "n_claims",
            n_items(F.try_variant_get(p, "$.claims", "array<variant>")).cast("bigint"),
        )
        .withColumn("claims", F.coalesce(F.try_variant_get(p, "$.claims", _CLAIMS), F.array().cast(_CLAIMS)))
        .withColumn(
            "details",
            F.concat(
                F.lit('{"claims":'),
                F.when(truthy(field("claims")), F.to_json(field("claims"))).otherwise("[]"),
                F.lit(',"raw_keys":'), F.to_json("raw_keys"), F.lit("}"),
            ),
        )
        .drop("_parsed")
    )


_CLAIMS = "array<struct<claim:string,supported:boolean,evidence:string>>"
_NOT_JSON = "The judge's reply held no JSON object."
# Fixed value: the fields an unreadable reply is reported with, in sorted order.
_FAILED_KEYS = ("chain_of_thought", "claims", "passed", "reasoning", "score")


def claim_support(claims: DataFrame, keys: list[str], supported: str = "supported") -> DataFrame:
    """Supported share of the claims of each key, from one row per claim."""
    counts = claims.groupBy(*keys).agg(
        F.count("*").alias("n_claims"), F.sum(F.col(supported).cast("int")).cast("bigint").alias("n_supported")
    )
    return counts.withColumn("_share", F.col("n_supported") / F.col("n_claims")).withColumn(
        "support", round_exact("_share")
    ).drop("_share")


def external_scores(df: DataFrame, backend: str, raw: str, threshold: float = PASS_CUTOFF) -> DataFrame:
    """Bound, pass-test (before rounding) and round an externally produced score.

    A missing ``deepeval`` score counts as 0; a missing ``ragas`` score means the
    scorer gave nothing and the row is dropped.
    """
    if backend == "ragas":
        df, limit = df.filter(F.col(raw).isNotNull()), PASS_CUTOFF
    else:
        limit = threshold
    return (
        df.withColumn("_b", clamp01(F.col(raw)))
        .withColumn("score", round_exact("_b"))
        .withColumn("passed", F.col("_b") >= F.lit(float(limit)))
        .withColumn("backend", F.lit(backend))
        .drop("_b")
    )


def choose_scores(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pick one score per (run, case, metric) by the requested backend.

    ``requests`` has keys plus ``eval_backend`` and ``judge_enabled``;
    ``candidates`` has keys plus ``backend`` (deepeval, ragas, judge, heuristic),
    score and passed. The adapter of the requested backend wins if it gave a
    score, then the judge if enabled, then the heuristic; with ``all`` adapters
    run but their scores are not used.
    """
    keys = ["eval_run_id", "case_id", "metric"]
    joined = requests.join(candidates, keys)
    adapter = F.col("backend").isin("deepeval", "ragas") & (F.col("backend") == F.col("eval_backend"))
    priority = (
        F.when(adapter, 1)
        .when((F.col("backend") == "judge") & F.col("judge_enabled"), 2)
        .when(F.col("backend") == "heuristic", 3)
    )
    usable = joined.withColumn("_p", priority).filter(F.col("_p").isNotNull() & F.col("score").isNotNull())
    best = F.min_by(F.struct("backend", "score", "passed"), "_p").alias("_best")
    return usable.groupBy(*keys).agg(best).select(*keys, "_best.*")


def error_classes(errors: DataFrame, code: str = "code") -> DataFrame:
    """Mark error codes that are worth a retry."""
    c = F.col(code)
    return errors.withColumn("retryable", c.isin(*RETRYABLE_CODES) | c.contains("Throttl") | c.contains("Timeout"))


def error_results(failed: DataFrame, error_type: str, message: str, trace: str) -> DataFrame:
    """Result row of a case whose scoring failed: no metrics, no answer."""
    return (
        failed.withColumn("answer", F.lit(""))
        .withColumn("error", F.concat_ws(": ", F.col(error_type), F.col(message)))
        .withColumn("traceback", F.right(F.col(trace), F.lit(TRACE_CHARS)))
        .withColumn("n_metrics", F.lit(0).cast("bigint"))
        .withColumn("input_tokens", F.lit(0).cast("bigint"))
        .withColumn("output_tokens", F.lit(0).cast("bigint"))
    )
