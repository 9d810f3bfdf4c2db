"""Streaming forms of dispatch, progress, timeouts, late results and averages.

No stream keeps state and none has a watermark that could discard rows. Each micro-batch is reduced to
partial rows (distinct keys, sums and counts) that are written to the batch log; a result merges the
partials of the log. So results do not depend on how files fall into batches or on the order of rows, a
replayed batch changes nothing, and late rows count. All partials are keyed by (run, shard) or finer
before they are keyed by run, so one large run spreads over all partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsieve.functions.numbers import as_exact, exact_ratio
from runsieve.operators.dispatch import shard_of
from runsieve.operators.runs import late_policy, mark_late
from runsieve.schemas import SHARD_SIZE
from runsieve.sources.golden import case_rows

RUN = "eval_run_id"


def dispatch_stream(datasets: DataFrame, size: int = SHARD_SIZE) -> DataFrame:
    """Arriving case sets to sharded cases; positions come from the document."""
    return case_rows(datasets, F.col("name")).withColumn("shard_id", shard_of(F.col("pos"), size))


def job_keys(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Partial: the dedup keys of a batch."""
    return jobs.select(*keys).distinct()


def unique_jobs(log: DataFrame, keys: list[str]) -> DataFrame:
    """One row per dedup key, however often and in whatever batches it was delivered."""
    return log.select(*keys).distinct()


def finished_shards(completions: DataFrame) -> DataFrame:
    """Partial: the shards that a batch finishes; repeats of a shard collapse."""
    return completions.groupBy(RUN, "shard_id").agg(F.max("n_cases").alias("n_cases"))


def run_progress(log: DataFrame) -> DataFrame:
    """Distinct finished shards and cases per run; redelivery changes nothing."""
    shards = finished_shards(log)
    return shards.groupBy(RUN).agg(F.count("*").alias("completed_shards"), F.sum("n_cases").alias("completed_cases"))


def started_runs(starts: DataFrame) -> DataFrame:
    """Partial: the starts of a batch."""
    return starts.select(RUN, "created_at").distinct()


def finished_runs(finishes: DataFrame) -> DataFrame:
    """Partial: the completions of a batch, copies collapsed."""
    return finishes.select(RUN, "finished_at").distinct()


def run_timeouts(starts: DataFrame, finishes: DataFrame, timeout_seconds: int, as_of: Column) -> DataFrame:
    """Runs without a completion within the limit at the time ``as_of`` of the sweep, from the two logs.

    The clock decides, not the arrival of completions: with none at all, every run older than the limit is due.
    """
    limit = F.expr(f"INTERVAL {int(timeout_seconds)} SECONDS")
    f = finishes.select(F.col(RUN).alias("_run"), "finished_at").distinct()
    in_time = (F.col(RUN) == F.col("_run")) & (F.col("finished_at") >= F.col("created_at")) & (F.col("finished_at") <= F.col("created_at") + limit)
    due = starts.distinct().filter(F.col("created_at") + limit < as_of)
    return due.join(f, in_time, "left_anti")


def late_results(results: DataFrame, gates: DataFrame, arrived: str = "ts", force: Column | None = None) -> DataFrame:
    """Label each arriving result on time, late, or (when forced) to be gated again."""
    return late_policy(mark_late(results, gates, arrived), force)


def window_sums(values: DataFrame, event_time: str, keys: list[str], value: str, period: str) -> DataFrame:
    """Partial: exact sum and count per tumbling window of a batch."""
    windowed = values.groupBy(F.window(event_time, period).alias("w"), *keys)
    return windowed.agg(F.sum(as_exact(F.col(value))).alias("total"), F.count(value).alias("n")).select(
        F.col("w.start").alias("window_start"), *keys, "total", "n"
    )


def window_means(log: DataFrame, keys: list[str]) -> DataFrame:
    """Order-independent mean and count per window over all partial sums."""
    sums = log.groupBy("window_start", *keys).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return sums.withColumn("mean", exact_ratio(F.col("total"), F.col("n"))).drop("total")
