"""Which answer of the agent is scored: recorded, candidate or live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsieve.functions.text import n_items, or_arr, or_str, strip
from runsieve.operators.retrieval import rank_case_passages
from runsieve.schemas import ALLOWED_TOOLS

# Lengths of the fallback answer and of the replayed snippet.
_FALLBACK_CHARS = 500
_SNIPPET_CHARS = 280
NO_CONTEXT_ANSWER = "Nothing was retrieved for this question."

_TEXTS = "array<string>"
_CALLS = "array<struct<name:string,arguments:string,result:string>>"


def fallback_answer(recorded: Column, expected: Column, contexts: Column) -> Column:
    """Recorded answer, expected answer, start of the first context, or a notice."""
    first = F.when(F.size(contexts) > 0, F.substring(F.get(contexts, 0), 1, _FALLBACK_CHARS))
    return F.coalesce(or_str(recorded, expected), first, F.lit(NO_CONTEXT_ANSWER))


def planned_tools(expected_tools: Column, recorded: Column, expected_contexts: Column) -> Column:
    """Names the candidate would call when no calls were recorded. A recorded trace without calls is a
    record of none."""
    names = F.coalesce(F.transform(recorded["tool_calls"], lambda c: c["name"]), F.array().cast(_TEXTS))
    recorded_names = F.when(recorded.isNotNull(), names)
    return F.coalesce(
        or_arr(expected_tools),
        recorded_names,
        F.when(F.size(expected_contexts) > 0, F.array(F.lit("search_docs"))),
        F.array().cast(_TEXTS),
    )


def replayed_calls(df: DataFrame, out: str = "tool_calls") -> DataFrame:
    """Call log of a candidate case: the recorded calls, else the planned ones.

    Planned names outside the allow list are dropped. The log is a projection of
    the case; nothing is executed.
    """
    recorded = F.col("recorded_trace")
    planned = F.filter(
        planned_tools(F.col("expected_tools"), recorded, F.col("expected_contexts")),
        lambda name: name.isin(*ALLOWED_TOOLS),
    )
    question = F.to_json(F.struct(F.col("query").alias("query")))
    snippet = F.coalesce(F.substring(F.get("expected_contexts", 0), 1, _SNIPPET_CHARS), F.lit(""))

    def call(name: Column) -> Column:
        warehouse = name == "warehouse_query"
        return F.struct(
            name.alias("name"),
            F.when(warehouse, F.lit('{"sql":"select 1"}')).otherwise(question).alias("arguments"),
            F.when(name == "search_docs", snippet).when(warehouse, F.lit("0")).otherwise(F.lit("ok")).alias("result"),
        )

    calls = F.coalesce(or_arr(recorded["tool_calls"]), F.transform(planned, call))
    return df.withColumn(out, calls)


def normalise_responses(responses: DataFrame, body: str = "body") -> DataFrame:
    """Bring agent replies (JSON text) to one shape; field aliases by truthiness."""
    shape = (
        "answer string, output string, retrieved_contexts array<string>, contexts array<string>, "
        "tool_calls array<struct<name:string,arguments:string,result:string>>, latency_ms bigint, metadata string"
    )
    r = F.col("_r")
    return (
        responses.withColumn("_r", F.from_json(F.col(body), shape))
        .withColumn("answer", F.coalesce(or_str(r["answer"], r["output"]), F.lit("")))
        .withColumn(
            "retrieved_contexts", F.coalesce(or_arr(r["retrieved_contexts"], r["contexts"]), F.array().cast(_TEXTS))
        )
        .withColumn("tool_calls", F.coalesce(r["tool_calls"], F.array().cast(_CALLS)))
        .withColumn("latency_ms", F.coalesce(r["latency_ms"], F.lit(0)))
        .withColumn("metadata", F.coalesce(r["metadata"], F.lit("{}")))
        .drop("_r")
    )


def _latency(df: DataFrame, field: str, parent: str | None = None) -> Column:
    """The latency of a trace in milliseconds, 0 where it is not told or the table has no such field."""
    known = df.columns if parent is None else df.schema[parent].dataType.names
    value = F.col(field if parent is None else f"{parent}.{field}") if field in known else F.lit(None)
    return F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint"))


def resolve_traces(cases: DataFrame, responses: DataFrame, k: int = 4, candidate_replies: DataFrame | None = None) -> DataFrame:
    """Add answer, retrieved_contexts, tool_names, tool_calls, latency_ms and error per case.

    ``cases`` carries ``eval_mode`` and ``agent_endpoint`` columns; ``responses``
    holds normalised live replies keyed by (eval_run_id, case_id), with an
    optional ``status_code``. ``candidate_replies`` holds the texts of the candidate
    model as ``reply_text`` under the same key; a missing or blank one gives the
    fallback answer. ``latency_ms`` is that of the trace or reply used, 0 where it has none. A case that cannot be resolved gets an error text instead of
    a failed stage.
    """
    keys = ["eval_run_id", "case_id"]
    live = responses.select(
        *keys,
        F.struct("answer", "retrieved_contexts", "tool_calls", _latency(responses, "latency_ms").alias("latency_ms")).alias("_live"),
        (F.col("status_code") if "status_code" in responses.columns else F.lit(200)).alias("_status"),
    )
    recorded, mode = F.col("recorded_trace"), F.col("eval_mode")
    whole = cases.join(live, keys, "left")
    if candidate_replies is None:
        whole = whole.withColumn("_said", F.lit(None).cast("string")).withColumn("_took", F.lit(0).cast("bigint"))
    else:
        took = _latency(candidate_replies, "latency_ms").alias("_took")
        whole = whole.join(candidate_replies.select(*keys, strip(F.col("reply_text")).alias("_said"), took), keys, "left")
    joined = replayed_calls(rank_case_passages(whole, k=k, out="_ranked", only=mode == "candidate"), out="_replayed")
    candidate = F.struct(
        F.coalesce(
            or_str(F.col("_said")), fallback_answer(recorded["answer"], F.col("expected_answer"), F.col("_ranked"))
        ).alias("answer"),
        F.col("_ranked").alias("retrieved_contexts"),
        F.col("_replayed").alias("tool_calls"),
        F.coalesce("_took", F.lit(0)).alias("latency_ms"),
    )
    stored = F.when(
        recorded.isNotNull(),
        F.struct(
            recorded["answer"].alias("answer"),
            F.coalesce(recorded["retrieved_contexts"], F.array().cast(_TEXTS)).alias("retrieved_contexts"),
            F.coalesce(recorded["tool_calls"], F.array().cast(_CALLS)).alias("tool_calls"),
            _latency(cases, "latency_ms", "recorded_trace").alias("latency_ms"),
        ),
    )
    usable = (or_str(F.col("agent_endpoint")).isNotNull()) & F.col("_live").isNotNull() & (F.col("_status") < 400)
    error = (
        F.when((mode == "offline") & recorded.isNull(), F.concat(F.lit("AgentError: no recorded trace for "), "case_id"))
        .when((mode == "online") & or_str(F.col("agent_endpoint")).isNull(), F.lit("AgentError: no endpoint is set"))
        .when((mode == "online") & F.col("_live").isNull(), F.lit("AgentError: no reply"))
        .when((mode == "online") & (F.col("_status") >= 400), F.concat(F.lit("AgentError: HTTP "), F.col("_status")))
        .when(~mode.isin("offline", "online", "candidate"), F.concat(F.lit("AgentError: unknown mode "), mode))
    )
    trace = (
        F.when(mode == "offline", stored)
        .when(mode == "candidate", candidate)
        .when((mode == "online") & usable, F.col("_live"))
    )
    return (
        joined.withColumn("error", error)
        .withColumn("_trace", trace)
        .withColumn("answer", F.coalesce("_trace.answer", F.lit("")))
        .withColumn("retrieved_contexts", F.coalesce("_trace.retrieved_contexts", F.array().cast(_TEXTS)))
        .withColumn("tool_calls", F.coalesce("_trace.tool_calls", F.array().cast(_CALLS)))
        .withColumn("latency_ms", F.coalesce("_trace.latency_ms", F.lit(0)))
        .withColumn("tool_names", F.transform("tool_calls", lambda c: c["name"]))
        .drop("_live", "_status", "_said", "_took", "_ranked", "_replayed", "_trace")
    )


def default_traces(cases: DataFrame) -> DataFrame:
    """Trace of a dry run: the recorded one, else the expected answer alone."""
    recorded = F.col("recorded_trace")
    return (
        cases.withColumn(
            "answer",
            F.when(recorded.isNotNull(), F.coalesce(recorded["answer"], F.lit(""))).otherwise(
                F.coalesce(or_str(F.col("expected_answer")), F.lit(""))
            ),
        )
        .withColumn("retrieved_contexts", F.coalesce(recorded["retrieved_contexts"], F.array().cast(_TEXTS)))
        .withColumn("tool_calls", F.coalesce(recorded["tool_calls"], F.array().cast(_CALLS)))
        .withColumn("tool_names", F.transform("tool_calls", lambda c: c["name"]))
        .withColumn("error", F.lit(None).cast("string"))
    )


def agent_requests(cases: DataFrame) -> DataFrame:
    """Rows to send to a live agent: case id, query and metadata as JSON."""
    body = F.to_json(F.struct("case_id", "query", F.coalesce("metadata", F.lit("{}")).alias("metadata")))
    return cases.select("eval_run_id", "case_id", body.alias("body"))


def candidate_requests(cases: DataFrame, k: int = 4) -> DataFrame:
    """Question and ranked passages to send to a candidate model."""
    ranked = rank_case_passages(cases, k=k, out="_ranked")
    passages = F.when(F.size("_ranked") > 0, F.array_join("_ranked", "\n---\n")).otherwise(F.lit("(none)"))
    text = F.concat_ws("\n", F.lit("Question:"), F.col("query"), F.lit("Passages:"), passages)
    return ranked.select(
        "eval_run_id", "case_id", text.alias("user_text"), n_items(F.col("_ranked")).cast("bigint").alias("n_passages")
    )
