"""Cases to results, results to reports, datasets to gated runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsieve.functions.numbers import round_exact
from runsieve.operators import aggregate as agg
from runsieve.operators.gate import gate
from runsieve.operators.scoring import metric_array, score_traces
from runsieve.operators.traces import default_traces, resolve_traces
from runsieve.schemas import METRICS, Thresholds

RUN = "eval_run_id"


def score_cases(traces: DataFrame, judge_model_id: str = "heuristic-local") -> DataFrame:
    """Case results from resolved traces; unresolved cases become error rows."""
    scored = metric_array(score_traces(traces))
    failed = F.col("error").isNotNull()
    no_metrics = F.filter("metrics", lambda m: F.lit(False))
    tokens = agg.case_tokens(F.col("metrics"))
    return (
        scored.withColumn("metrics", F.when(failed, no_metrics).otherwise(F.col("metrics")))
        .withColumn("_t", tokens)
        .withColumn("input_tokens", F.col("_t.input_tokens"))
        .withColumn("output_tokens", F.col("_t.output_tokens"))
        .withColumn("answer", F.when(failed, "").otherwise(F.col("answer")))
        .withColumn("judge_model_id", F.lit(judge_model_id))
        .withColumn("case_passed", agg.case_passed(F.col("error"), F.col("metrics")))
        .withColumn("has_error", failed)
        .drop("_t")
    )


def evaluate_cases(cases: DataFrame, responses: DataFrame) -> DataFrame:
    """Resolve and score every case by its run's mode (lexical scorers)."""
    return score_cases(resolve_traces(cases, responses))


def build_reports(facts: DataFrame, runs: DataFrame | None = None, thresholds: Thresholds | None = None) -> DataFrame:
    """One gated report per run.

    ``facts`` are result facts (one row per metric and one per case outcome).
    ``runs`` gives eval_run_id, total_cases, optional timed_out and thresholds;
    its runs without results are kept. Without it the runs are those with facts.
    """
    return reports_from_histogram(agg.fact_histogram(facts), runs, thresholds)


def reports_from_histogram(hist: DataFrame, runs: DataFrame | None = None, thresholds: Thresholds | None = None) -> DataFrame:
    """``build_reports`` from counted facts (run, metric, score, c and tokens), which are read several times."""
    counts = agg.with_thresholds(agg.run_case_counts(hist, runs), thresholds)
    if "timed_out" not in counts.columns:
        counts = counts.withColumn("timed_out", F.lit(False))
    scores = hist.filter(F.col("metric").isin(*METRICS)).select(RUN, "metric", "score", "c")
    overall = agg.overall_scores(agg.aggregates_from_histogram(scores, counts.select(RUN, "thresholds")))
    gated = gate(agg.with_cost(agg.with_rates(counts)).join(overall, RUN))
    return gated.withColumn("pass_rate", round_exact("pass_rate")).withColumn(
        "error_rate", round_exact("error_rate")
    )


def results_to_reports(results: DataFrame, runs: DataFrame | None = None, thresholds: Thresholds | None = None) -> DataFrame:
    """Reports from de-duplicated case results with their metrics array."""
    return build_reports(agg.result_facts(results), runs, thresholds)


def evaluate_dataset(cases: DataFrame, thresholds: Thresholds | None = None) -> DataFrame:
    """Score recorded (else expected) answers of all runs and gate each run."""
    results = score_cases(default_traces(cases))
    return results_to_reports(results, thresholds=thresholds).withColumn("judge_model_id", F.lit("heuristic-local"))


def report_row(report: DataFrame, run_date: Column | None = None) -> DataFrame:
    """Flat report columns in a fixed order, ready for a table."""
    base = [
        RUN, "status", "gate_passed", "failures", "overall_score", "total_cases", "completed_cases", "passed_cases",
        "failed_cases", "error_cases", "pass_rate", "error_rate", "metrics", "thresholds", "estimated_cost_usd",
    ]
    out = report.select(*base)
    return out if run_date is None else out.withColumn("run_date", run_date)
