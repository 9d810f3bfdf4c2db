"""Pass / fail / timeout decisions and the next action of a run."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsieve.functions.numbers import fixed, percent
from runsieve.schemas import GATED_STATUSES, OPEN_STATUSES, RUN_TIMEOUT_SECONDS


def gate(df: DataFrame) -> DataFrame:
    """Add status, gate_passed and the ordered list of failures.

    Needs overall_score, error_rate (unrounded), completed_cases, total_cases,
    timed_out and a ``thresholds`` struct. Only the timeout, missing results, the
    error rate and the overall score can fail a run. What is unknown (NULL or NaN) fails as well: no run
    passes on a number that is not there.
    """
    t, done = F.col("thresholds"), F.coalesce(F.col("completed_cases"), F.lit(0))
    timeout = F.coalesce(F.col("timed_out"), F.lit(False))

    def unknown(*values: Column) -> Column:
        return functools.reduce(lambda a, b: a | b, [v.isNull() | F.isnan(v) for v in values])

    failures = F.array_compact(
        F.array(
            F.when(
                timeout,
                F.concat(
                    F.lit("timed out with "), done.cast("string"), F.lit(" of "),
                    F.coalesce(F.col("total_cases").cast("string"), F.lit("unknown")), F.lit(" cases done"),
                ),
            ),
            F.when(F.col("timed_out").isNull(), F.lit("unknown whether it timed out")),
            F.when(done == 0, F.lit("no case has a result")),
            F.when(unknown(F.col("error_rate"), t["max_error_rate"]), F.lit("error rate is unknown")).when(
                F.col("error_rate") > t["max_error_rate"],
                F.concat(
                    F.lit("error rate "), percent("error_rate", 2), F.lit(" is above "), percent("thresholds.max_error_rate", 2)
                ),
            ),
            F.when(unknown(F.col("overall_score"), t["overall"]), F.lit("overall score is unknown")).when(
                F.col("overall_score") < t["overall"],
                F.concat(F.lit("overall score "), fixed("overall_score", 3), F.lit(" is below "), fixed("thresholds.overall", 3)),
            ),
        )
    )
    failed = F.size("failures") > 0
    return (
        df.withColumn("failures", failures)
        .withColumn("gate_passed", ~failed)
        .withColumn("status", F.when(timeout & (done == 0), "timeout").when(failed, "fail").otherwise("pass"))
    )


def timed_out(created_at: Column, as_of: Column, timeout_seconds: int | Column = RUN_TIMEOUT_SECONDS) -> Column:
    """Whole seconds since creation have reached the limit."""
    limit = timeout_seconds if isinstance(timeout_seconds, Column) else F.lit(timeout_seconds)
    return F.unix_seconds(as_of) - F.unix_seconds(created_at) >= limit


def utc_instant(stamp: Column) -> Column:
    """ISO-8601 text as a timestamp; text without an offset is UTC (session zone)."""
    return stamp.try_cast("timestamp")


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def open_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("status").isin(*OPEN_STATUSES))


def run_actions(runs: DataFrame, as_of: Column, timeout_seconds: int = RUN_TIMEOUT_SECONDS) -> DataFrame:
    """Add complete, timed_out, gate_timed_out and action (skip, wait, aggregate).

    Needs status, n_results, total_cases, completed_shards, total_shards,
    created_at and force. A timed-out or failed-by-error run is not skipped. An unknown count counts as 0,
    a run of unknown size is not complete and one of unknown age is not timed out.
    """

    def reached(count: str, total: str) -> Column:
        return F.coalesce(F.coalesce(F.col(count), F.lit(0)) >= F.col(total), F.lit(False))

    complete = reached("n_results", "total_cases") | reached("completed_shards", "total_shards")
    force = F.coalesce(F.col("force"), F.lit(False))
    return (
        runs.withColumn("complete", complete)
        .withColumn("timed_out", F.coalesce(timed_out(F.col("created_at"), as_of, timeout_seconds), F.lit(False)))
        .withColumn("gate_timed_out", F.col("timed_out") & ~F.col("complete"))
        .withColumn(
            "action",
            F.when(F.col("status").isin(*GATED_STATUSES) & ~force, "skip")
            .when(~F.col("complete") & ~F.col("timed_out") & ~force, "wait")
            .otherwise("aggregate"),
        )
    )
