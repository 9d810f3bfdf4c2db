"""Stored result files and run manifests to gated reports and everything that follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsieve.operators import aggregate as agg
from runsieve.operators import reports as rep
from runsieve.operators.gate import iso_text, run_actions, utc_instant
from runsieve.plans.evaluate import results_to_reports
from runsieve.schemas import RUN_TIMEOUT_SECONDS

RUN = "eval_run_id"


def stored_results(rows: DataFrame) -> DataFrame:
    """Last delivery of each case, from ``parse_result_documents`` rows, with has_error and case_passed.

    Deliveries are ordered by shard, place in the file and path. Rows without run or case id are no results.
    """
    known = rows.filter(F.col(RUN).isNotNull() & F.col("case_id").isNotNull())
    last = agg.latest_results(known, ["shard_id", "pos", "file_path"])
    error = F.when(F.col("error") != "", F.col("error"))
    return last.withColumn("has_error", error.isNotNull()).withColumn("case_passed", agg.case_passed(error, F.col("metrics")))


def runs_to_gate(results: DataFrame, runs: DataFrame, as_of: Column, timeout_seconds: int = RUN_TIMEOUT_SECONDS) -> DataFrame:
    """Manifest rows with n_results, complete, timed_out, gate_timed_out and action.

    ``runs`` are rows of ``decode_runs`` and may carry ``force``. Rows that could not be decoded get the
    action ``unreadable``.
    """
    if "force" not in runs.columns:
        runs = runs.withColumn("force", F.lit(False))
    counts = results.groupBy(RUN).agg(F.count("*").alias("n_results"))
    known = runs.join(counts, RUN, "left").withColumn("created_at", utc_instant(F.col("created_at")))
    unreadable = F.col("decode_error").isNotNull() if "decode_error" in runs.columns else F.lit(False)
    acted = run_actions(known, as_of, timeout_seconds)
    return acted.withColumn("action", F.when(unreadable, "unreadable").otherwise(F.col("action")))


def aggregate_runs(results: DataFrame, runs: DataFrame, as_of: Column, timeout_seconds: int = RUN_TIMEOUT_SECONDS) -> DataFrame:
    """One gated report per run that is complete, timed out or forced, by the run's own thresholds.

    ``results`` are rows of ``stored_results``, ``runs`` rows of ``decode_runs``. Reports keep the manifest's
    source, judge and candidate and creation time. Runs that wait, are gated already or cannot be read
    give no row; their results take no part.
    """
    chosen = runs_to_gate(results, runs, as_of, timeout_seconds).filter("action = 'aggregate'")
    wanted = chosen.select(
        RUN, "total_cases", F.col("gate_timed_out").alias("timed_out"), "thresholds", "source", "judge_model_id", "candidate_model_id",
        "dataset_s3_uri", "dataset_version", "dataset_name", iso_text(F.col("created_at")).alias("created_at"),
    )
    mine = results.join(wanted.select(RUN), RUN, "left_semi")
    return results_to_reports(mine, wanted).withColumn("gated_at", iso_text(as_of))


def run_outputs(reports: DataFrame, results: DataFrame, uri_root: str, environment: str, has_webhook: Column, has_token: Column) -> dict[str, DataFrame]:
    """What follows from gated reports, as tables to write.

    ``reports`` (with uri and JSON), ``markdown``, ``series`` (metric rows), ``outbox`` (messages with their
    address), ``audit`` (index rows of the cases and, keyed by run, of the reports) and ``statuses`` (events
    for the log that ``latest_status`` reads).
    """
    sha, json = F.col("source.git_sha"), rep.report_json(reports, uri_root)
    run_docs = json.select(F.lit("reports").alias("index_name"), F.col(RUN).alias("doc_id"), F.col("report_json").alias("doc"))
    case_docs = rep.audit_documents(results.join(reports.select(RUN), RUN, "left_semi"))
    return {
        "reports": json,
        "markdown": rep.markdown(reports).select(RUN, "markdown"),
        "series": rep.gate_metrics_long(reports, environment, sha),
        "outbox": rep.notification_outbox(reports, F.col("source.repo"), sha, F.col("source.pr_number"), has_webhook, has_token),
        "audit": case_docs.withColumn("doc", F.to_json("doc")).unionByName(run_docs),
        "statuses": reports.select(RUN, "status", F.col("gated_at").alias("updated_at"), F.lit(None).cast("string").alias("error")),
    }
