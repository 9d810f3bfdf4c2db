"""Declared schemas, enumerations and default settings."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Enumerations of the data model.
EVAL_MODES = ("offline", "online", "candidate")
EVAL_BACKENDS = ("native", "deepeval", "ragas", "all")
SUITES = ("rag", "tool_calling", "hybrid")
RUN_STATUSES = ("pending", "running", "aggregating", "pass", "fail", "error", "timeout")
OPEN_STATUSES = ("pending", "running", "aggregating")
GATED_STATUSES = ("pass", "fail")
METRICS = ("faithfulness", "answer_relevance", "tool_selection_precision")
ALLOWED_TOOLS = ("search_docs", "lookup_oncall", "create_incident", "create_ticket", "warehouse_query")

# Limits.
PASS_CUTOFF = 0.85
SHARD_SIZE = 8
RUN_TIMEOUT_SECONDS = 1800
JOB_MAX_RECEIVES = 3
RESULT_MAX_RECEIVES = 5
INPUT_USD_PER_MTOK = 0.80
OUTPUT_USD_PER_MTOK = 4.00


@dataclass(frozen=True)
class Thresholds:
    """Gate settings of a run, each in [0, 1]."""

    overall: float = 0.85
    faithfulness: float = 0.85
    answer_relevance: float = 0.85
    tool_selection_precision: float = 0.85
    min_pass_rate: float = 0.85
    max_error_rate: float = 0.05

    def __post_init__(self) -> None:
        for field in fields(self):
            if not 0.0 <= getattr(self, field.name) <= 1.0:
                raise ValueError(f"threshold {field.name} must be within [0, 1]")

    def as_column(self) -> Column:
        """The same struct value on every row."""
        return F.struct(*[F.lit(float(getattr(self, f.name))).alias(f.name) for f in fields(self)])


THRESHOLDS = T.StructType([T.StructField(f.name, T.DoubleType()) for f in fields(Thresholds)])
TOOL_CALL = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("arguments", T.StringType()),
        T.StructField("result", T.StringType()),
    ]
)
TRACE = T.StructType(
    [
        T.StructField("answer", T.StringType()),
        T.StructField("retrieved_contexts", T.ArrayType(T.StringType())),
        T.StructField("tool_calls", T.ArrayType(TOOL_CALL)),
        T.StructField("latency_ms", T.LongType()),
        T.StructField("metadata", T.StringType()),
    ]
)
CASE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("suite", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("expected_answer", T.StringType()),
        T.StructField("expected_contexts", T.ArrayType(T.StringType())),
        T.StructField("expected_tools", T.ArrayType(T.StringType())),
        T.StructField("expected_tool_calls", T.ArrayType(TOOL_CALL)),
        T.StructField("recorded_trace", TRACE),
        T.StructField("metadata", T.StringType()),
    ]
)
GOLDEN = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("cases", T.ArrayType(CASE)),
    ]
)
METRIC = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("passed", T.BooleanType()),
        T.StructField("reasoning", T.StringType()),
        T.StructField("chain_of_thought", T.StringType()),
        T.StructField("details", T.StringType()),
        T.StructField("judge_model_id", T.StringType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
    ]
)
CASE_RESULT = T.StructType(
    [
        T.StructField("eval_run_id", T.StringType()),
        T.StructField("case_id", T.StringType()),
        T.StructField("shard_id", T.LongType()),
        T.StructField("suite", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("metrics", T.ArrayType(METRIC)),
        T.StructField("latency_ms", T.LongType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("judge_model_id", T.StringType()),
        T.StructField("candidate_model_id", T.StringType()),
        T.StructField("tool_call_logs", T.ArrayType(TOOL_CALL)),
        T.StructField("retrieved_contexts", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),
        T.StructField("evaluated_at", T.StringType()),
        T.StructField("metadata", T.StringType()),
    ]
)
SOURCE_REF = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("pr_number", T.LongType()),
        T.StructField("git_sha", T.StringType()),
        T.StructField("check_run_id", T.LongType()),
        T.StructField("installation_id", T.LongType()),
    ]
)
DATASET_MANIFEST = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("git_sha", T.StringType()),
        T.StructField("s3_uri", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("case_count", T.LongType()),
        T.StructField("created_at", T.StringType()),
    ]
)
RUN_MANIFEST = T.StructType(
    [
        T.StructField("eval_run_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("dataset_s3_uri", T.StringType()),
        T.StructField("dataset_version", T.StringType()),
        T.StructField("dataset_name", T.StringType()),
        T.StructField("dataset_manifest_id", T.StringType()),
        T.StructField("total_cases", T.LongType()),
        T.StructField("total_shards", T.LongType()),
        T.StructField("completed_shards", T.LongType()),
        T.StructField("completed_cases", T.LongType()),
        T.StructField("eval_mode", T.StringType()),
        T.StructField("eval_backend", T.StringType()),
        T.StructField("judge_model_id", T.StringType()),
        T.StructField("candidate_model_id", T.StringType()),
        T.StructField("agent_endpoint", T.StringType()),
        T.StructField("source", SOURCE_REF),
        T.StructField("thresholds", THRESHOLDS),
        T.StructField("created_at", T.StringType()),
        T.StructField("updated_at", T.StringType()),
        T.StructField("expires_at_epoch", T.LongType()),
    ]
)

#: What a run manifest says where a field is absent.
RUN_DEFAULTS = {"dataset_version": "1.0", "dataset_name": "golden", "eval_mode": "candidate", "eval_backend": "deepeval"}


def column_list(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields]
