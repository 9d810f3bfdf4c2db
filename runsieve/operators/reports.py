"""Reports, texts, audit rows, metric rows and notification outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsieve.functions.numbers import fixed, fixed_sql, percent, percent_sql
from runsieve.functions.text import or_str

_SUMMARY_CHARS = 65535  # fixed values: limits of the receiving services
_BLOCK_CHARS = 2500
_SHA_CHARS = 40
_MAX_FAILURES = 8

# Series names of the three metric means.
SERIES = {
    "faithfulness": "Faithfulness",
    "answer_relevance": "AnswerRelevance",
    "tool_selection_precision": "ToolPrecision",
}


def titles(report: DataFrame, out: str = "title") -> DataFrame:
    """One line per run: verdict, overall score, threshold, run id."""
    verb = F.when(F.col("gate_passed"), "passed").otherwise("failed")
    return report.withColumn(
        out,
        F.concat(
            F.lit("Evaluation "), verb, F.lit(": overall "), fixed("overall_score", 3), F.lit(" against "),
            fixed("thresholds.overall", 2), F.lit(" in "), F.col("eval_run_id"),
        ),
    )


def markdown(report: DataFrame, out: str = "markdown") -> DataFrame:
    """Markdown text of a report: headline, bullets, metric table, failures."""

    cells = [
        "m.metric", fixed_sql("m.mean", 3), fixed_sql("m.p50", 3), fixed_sql("m.p95", 3), fixed_sql("m.threshold", 2),
        percent_sql("m.pass_rate"), "CASE WHEN NOT m.gated AND m.n > 0 THEN 'ok' ELSE 'below' END",
    ]
    rows = F.expr(f"transform(metrics, m -> concat('| ', concat_ws(' | ', {', '.join(cells)}), ' |'))")
    lines = F.concat(
        F.array(
            F.concat(F.lit("# Evaluation "), F.when(F.col("gate_passed"), "PASS").otherwise("FAIL")),
            F.lit(""),
            F.concat(F.lit("* overall score "), fixed("overall_score", 3), F.lit(", needed "), fixed("thresholds.overall", 2)),
            F.concat(F.lit("* run "), F.col("eval_run_id")),
            F.concat(F.lit("* judge "), F.coalesce("judge_model_id", F.lit("none"))),
            F.concat(
                F.lit("* cases passed "), F.col("passed_cases").cast("string"), F.lit(" of "), F.col("completed_cases").cast("string"),
                F.lit(" ("), percent("pass_rate"), F.lit("), errors "), percent("error_rate"),
            ),
            F.concat(F.lit("* estimated cost USD "), fixed("estimated_cost_usd", 4)),
            F.lit(""),
            F.lit("| metric | mean | p50 | p95 | threshold | pass rate | flag |"),
            F.lit("|---|---|---|---|---|---|---|"),
        ),
        rows,
        F.when(
            F.size("failures") > 0,
            F.concat(F.array(F.lit(""), F.lit("Reasons:")), F.transform("failures", lambda f: F.concat(F.lit("* "), f))),
        ).otherwise(F.array().cast("array<string>")),
    )
    return report.withColumn(out, F.array_join(lines, "\n"))


def notification_outbox(report: DataFrame, repo: Column, git_sha: Column, pr_number: Column, has_webhook: Column, has_token: Column) -> DataFrame:
    """Messages to send for a run, or the reason why none is sent.

    Nothing is delivered here; a sender reads this table, which also says where to: repo, git_sha, pr_number.
    """
    df = titles(markdown(report)).select("*", repo.alias("_repo"), git_sha.alias("_sha"), pr_number.alias("_pr"))
    passed = F.col("gate_passed")
    listed = F.transform(F.slice("failures", 1, _MAX_FAILURES), lambda f: F.concat(F.lit("- "), f))
    text = F.concat(
        F.lit("Evaluation FAILED for "), F.coalesce(or_str(F.col("_repo")), F.lit("repo")), F.lit(" at "),
        F.coalesce(or_str(F.col("_sha")), F.lit("-")), F.lit(": overall "), fixed("overall_score", 3),
        F.lit(", needed "), fixed("thresholds.overall", 2), F.lit("\n"), F.array_join(listed, "\n"),
    )
    known = or_str(F.col("_repo")).isNotNull() & or_str(F.col("_sha")).isNotNull() & has_token
    return (
        df.withColumn("chat_skip_reason", F.when(passed, "gate_passed").when(~has_webhook, "missing_webhook"))
        .withColumn("chat_text", F.when(F.col("chat_skip_reason").isNull(), text))
        .withColumn("chat_block", F.when(F.col("chat_skip_reason").isNull(), F.substring("markdown", 1, _BLOCK_CHARS)))
        .withColumn("check_skip_reason", F.when(~known, "missing_credentials_or_context"))
        .withColumn("check_conclusion", F.when(known, F.when(passed, "success").otherwise("failure")))
        .withColumn("check_title", F.when(known, F.col("title")))
        .withColumn("check_summary", F.when(known, F.substring("markdown", 1, _SUMMARY_CHARS)))
        .withColumn("comment_body", F.when(known & (F.coalesce("_pr", F.lit(0)) != 0), F.col("markdown")))
        .select(
            "eval_run_id", "chat_skip_reason", "chat_text", "chat_block", "check_skip_reason", "check_conclusion",
            "check_title", "check_summary", "comment_body", or_str(F.col("_repo")).alias("repo"),
            or_str(F.col("_sha")).alias("git_sha"), F.col("_pr").alias("pr_number"),
        )
    )


def gate_metrics_long(report: DataFrame, environment: str, git_sha: Column) -> DataFrame:
    """Seven metric rows per run, with environment and commit as dimensions."""
    named = {
        "OverallScore": F.col("overall_score"),
        "PassRate": F.col("pass_rate"),
        "ErrorRate": F.col("error_rate"),
        "GatePass": F.when(F.col("gate_passed"), 1.0).otherwise(0.0),
    }
    plain = F.array(*[F.struct(F.lit(k).alias("metric_name"), v.alias("value")) for k, v in named.items()])
    series = F.create_map(*[F.lit(x) for pair in SERIES.items() for x in pair])
    means = F.transform(
        "metrics", lambda m: F.struct(F.coalesce(F.element_at(series, m["metric"]), m["metric"]).alias("metric_name"), m["mean"].alias("value"))
    )
    sha = F.substring(F.coalesce(or_str(git_sha), F.lit("unknown")), 1, _SHA_CHARS)
    return report.select(
        "eval_run_id", F.lit(environment).alias("environment"), sha.alias("git_sha"), F.explode(F.concat(plain, means)).alias("_m")
    ).select("eval_run_id", "environment", "git_sha", "_m.metric_name", "_m.value")


def audit_documents(results: DataFrame) -> DataFrame:
    """Two index rows per case result (same document), keyed by run and case."""
    audit = F.struct(
        F.transform(F.coalesce("metrics", F.array()), lambda m: m["chain_of_thought"]).alias("chain_of_thought"),
        F.col("tool_call_logs"),
        F.col("retrieved_contexts"),
    )
    docs = results.select(
        F.concat_ws(":", "eval_run_id", "case_id").alias("doc_id"), F.struct(*results.columns, audit.alias("audit")).alias("doc")
    )
    return docs.select(F.explode(F.array(F.lit("audit"), F.lit("cases"))).alias("index_name"), "doc_id", "doc")


def pick_metric(report: DataFrame, name: str, field: str, out: str) -> DataFrame:
    """One number of one metric aggregate of a report; NULL when absent."""
    return report.withColumn(out, F.get(F.filter("metrics", lambda m: m["metric"] == name), 0)[field])


def report_json(report: DataFrame, uri_root: str) -> DataFrame:
    """Report rows with their target uri and JSON text, ready to write once."""
    placed = report.withColumn("report_uri", F.concat(F.lit(uri_root.rstrip("/") + "/runs/"), "eval_run_id", F.lit("/report.json")))
    return placed.withColumn("report_json", F.to_json(F.struct(*placed.columns)))
