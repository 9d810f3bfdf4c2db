"""One complete result row per case from all scorers: heuristics, judges and adapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsieve.operators.aggregate import CASE_KEY, case_passed, case_tokens, with_thresholds
from runsieve.operators.scoring import score_traces
from runsieve.operators.traces import resolve_traces
from runsieve.operators.verdicts import TRACE_CHARS, judge_verdicts, model_replies
from runsieve.schemas import CASE_RESULT, METRIC, METRICS, PASS_CUTOFF

#: Metrics that a judge or an adapter may score; tools are scored from the trace alone.
JUDGED = METRICS[:2]
ADAPTERS = ("deepeval", "ragas")

_METRICS_TYPE = f"array<{METRIC.simpleString()}>"
_REASONS = {METRICS[0]: "share of the answer found in its contexts", METRICS[1]: "tokens shared with the query or the expected answer"}


def _by_case(rows: DataFrame, name: Column, value: Column, names: list[str]) -> DataFrame:
    """One row per case with a struct column per name; of repeated rows the largest value counts, so
    that redelivery does not change the choice."""
    named = rows.select(*CASE_KEY, name.alias("_name"), value.alias("_value"))
    return named.groupBy(*CASE_KEY).agg(*[F.max(F.when(F.col("_name") == n, F.col("_value"))).alias(n) for n in names])


def judge_scores(replies: DataFrame) -> DataFrame:
    """Columns ``judge_<metric>`` per case from model replies (run, case, metric, JSON body)."""
    read = judge_verdicts(model_replies(replies), threshold=F.lit(None).cast("double"))
    value = F.struct("score", "passed", "reasoning", "chain_of_thought", "details", "input_tokens", "output_tokens")
    return _by_case(read, F.concat(F.lit("judge_"), "metric"), value, [f"judge_{m}" for m in JUDGED])


def adapter_scores(rows: DataFrame) -> DataFrame:
    """Columns ``<backend>_<metric>`` per case from rows of ``external_scores`` with run, case and metric.

    Rows of ``apply_scorer`` may carry ``error`` and ``traceback``; a delivery with a score counts before a failed one.
    """
    names = [f"{b}_{m}" for b in ADAPTERS for m in JUDGED]
    for name in ("error", "traceback"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    given = rows.filter("score IS NOT NULL OR error IS NOT NULL")
    return _by_case(given, F.concat_ws("_", "backend", "metric"), F.struct("score", "passed", "error", "traceback"), names)


def _metric(name: str, score: Column, passed: Column, reasoning: Column, thought: Column, details: Column, judge: Column, tokens: list[Column]) -> Column:
    """A metric in the order of the declared type."""
    values = [F.lit(name), score, passed, reasoning, thought, details, judge, *tokens]
    return F.struct(*[v.cast(f.dataType).alias(f.name) for v, f in zip(values, METRIC.fields, strict=True)])


def _judged_metric(name: str) -> Column:
    """The metric of the requested adapter if it gave a score, else of the judge if enabled, else lexical.

    With the backend ``all`` adapters run beside the judge and their scores are not used.
    """
    none, zeros = F.lit(None), [F.lit(0), F.lit(0)]
    judge = F.col(f"judge_{name}")
    choice = None
    for b in ADAPTERS:
        got = F.col(f"{b}_{name}")
        row = _metric(name, got["score"], got["passed"], F.lit(f"scored by {b}"), F.lit(b), F.lit("{}"), none, zeros)
        wanted = (F.col("eval_backend") == b) & got["score"].isNotNull()
        choice = F.when(wanted, row) if choice is None else choice.when(wanted, row)
    passed = F.coalesce(judge["passed"], judge["score"] >= F.col("thresholds")[name])
    judged = _metric(
        name, judge["score"], passed, judge["reasoning"], judge["chain_of_thought"], judge["details"], F.col("judge_model_id"),
        [judge["input_tokens"], judge["output_tokens"]],
    )
    lexical = _metric(name, F.col(name), F.col(name) >= PASS_CUTOFF, F.lit(_REASONS[name]), F.lit("lexical scorer"), F.lit("{}"), none, zeros)
    return choice.when(F.coalesce(F.col("judge_enabled"), F.lit(False)), judged).otherwise(lexical)


def _unjudged(name: str) -> Column:
    """Error text of a case whose judge is needed and has not replied."""
    used = [(F.col("eval_backend") == b) & F.col(f"{b}_{name}.score").isNotNull() for b in ADAPTERS]
    needed = F.coalesce(F.col("judge_enabled"), F.lit(False)) & ~F.coalesce(used[0] | used[1], F.lit(False))
    return F.when(needed & F.col(f"judge_{name}").isNull(), F.lit(f"JudgeError: no reply on {name}"))


def _scorer_failure(field: str) -> Column:
    """``error`` or ``traceback`` of the first metric on which an adapter of the backend failed; ``all`` runs both."""
    failed = [
        F.when(F.col("eval_backend").isin(b, "all") & F.col(f"{b}_{m}.score").isNull(), F.struct(F.col(f"{b}_{m}.error").alias("error"), F.col(f"{b}_{m}.traceback").alias("traceback")))
        for m in JUDGED
        for b in ADAPTERS
    ]
    return F.coalesce(*[F.when(f["error"].isNotNull(), f) for f in failed])[field]


def case_results(
    cases: DataFrame,
    live: DataFrame,
    judge_replies: DataFrame,
    adapter_rows: DataFrame,
    candidate_replies: DataFrame | None = None,
    evaluated_at: Column | None = None,
) -> DataFrame:
    """Complete result rows (``CASE_RESULT`` plus has_error and case_passed), one per case.

    ``cases`` carries eval_mode, agent_endpoint, eval_backend and judge_enabled, and may carry shard_id,
    thresholds, judge_model_id and candidate_model_id. ``live`` are normalised agent replies,
    ``judge_replies`` and ``candidate_replies`` model replies as JSON bodies, ``adapter_rows`` scores of
    external scorers; all are keyed by (run, case) and may be redelivered or missing. A case that cannot be
    resolved, on which an adapter of its backend failed, or whose judge is needed and silent, is an error row without metrics.
    ``latency_ms`` is that of the trace in use, also on error rows. ``metadata`` of an error row is a JSON object
    with the end of the scorer's traceback, or of the error text where no scorer ran.

    All joins are on (run, case), so cases are shuffled once; everything after them is one narrow stage.
    """
    for name, kind in (("shard_id", "bigint"), ("judge_model_id", "string"), ("candidate_model_id", "string")):
        if name not in cases.columns:
            cases = cases.withColumn(name, F.lit(None).cast(kind))
    said = None
    if candidate_replies is not None:
        said = model_replies(candidate_replies).groupBy(*CASE_KEY).agg(F.max("reply_text").alias("reply_text"))
    whole = cases.join(judge_scores(judge_replies), CASE_KEY, "left").join(adapter_scores(adapter_rows), CASE_KEY, "left")
    scored = score_traces(with_thresholds(resolve_traces(whole, live, candidate_replies=said)))
    tools = _metric(
        METRICS[2], F.col(METRICS[2]), F.col(METRICS[2]) >= PASS_CUTOFF, F.col("tool_reasoning"), F.col("tool_thought"),
        F.to_json(F.struct(
            F.col("tool_expected").alias("expected"), F.col("tool_actual").alias("actual"), F.col("tool_precision").alias("precision"),
            F.col("tool_recall").alias("recall"), F.col("tool_f1").alias("f1"),
        )),
        F.lit(None), [F.lit(0), F.lit(0)],
    )
    trace = F.when(F.col("error").isNull(), _scorer_failure("traceback"))
    scored = scored.withColumn("_trace", trace).withColumn("error", F.coalesce("error", _scorer_failure("error"), *[_unjudged(m) for m in JUDGED]))
    failed, none = F.col("error").isNotNull(), F.array()
    metrics = F.array(*[_judged_metric(m) for m in JUDGED], tools)
    rows = scored.withColumn("metrics", F.when(failed, none.cast(_METRICS_TYPE)).otherwise(metrics.cast(_METRICS_TYPE)))
    rows = rows.withColumn("_tokens", case_tokens(F.col("metrics")))
    calls, texts = CASE_RESULT["tool_call_logs"].dataType, "array<string>"
    values = {
        "answer": F.when(failed, "").otherwise(F.col("answer")),
        "latency_ms": F.col("latency_ms"),
        "input_tokens": F.col("_tokens.input_tokens"),
        "output_tokens": F.col("_tokens.output_tokens"),
        "tool_call_logs": F.when(failed, none.cast(calls)).otherwise(F.col("tool_calls")),
        "retrieved_contexts": F.when(failed, none.cast(texts)).otherwise(F.col("retrieved_contexts")),
        "metadata": F.when(failed, F.to_json(F.struct(F.right(F.coalesce("_trace", "error"), F.lit(TRACE_CHARS)).alias("traceback")))).otherwise(F.col("metadata")),
        "evaluated_at": F.lit(None) if evaluated_at is None else evaluated_at,
    }
    out = [values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in CASE_RESULT.fields]
    return rows.select(*out, failed.alias("has_error"), case_passed(F.col("error"), F.col("metrics")).alias("case_passed"))
