"""Run state: progress, completeness, late results, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsieve.operators.ranking import latest_by
from runsieve.schemas import RESULT_MAX_RECEIVES

RUN = "eval_run_id"


def shard_summary(results: DataFrame) -> DataFrame:
    """Cases and errors of every (run, shard)."""
    return results.groupBy(RUN, "shard_id").agg(
        F.count("*").alias("cases"), F.count_if(F.col("error").isNotNull() & (F.col("error") != "")).alias("errors")
    )


def shard_progress(completions: DataFrame) -> DataFrame:
    """Distinct finished shards and their cases; redelivery changes nothing.

    ``completions`` has one row per delivery: eval_run_id, shard_id, n_cases.
    ``deliveries`` is what a plain counter would have counted.
    """
    per_shard = completions.groupBy(RUN, "shard_id").agg(F.max("n_cases").alias("n_cases"), F.count("*").alias("d"))
    return per_shard.groupBy(RUN).agg(
        F.count("*").alias("completed_shards"),
        F.sum("n_cases").alias("completed_cases"),
        F.sum("d").alias("deliveries"),
    )


def run_ids(batch: DataFrame) -> DataFrame:
    """Distinct run ids of a batch of completion messages; messages without one are skipped."""
    return batch.filter(F.col(RUN).isNotNull()).select(RUN).distinct()


def join_manifests(results: DataFrame, state: DataFrame, stored: DataFrame, fields: list[str]) -> DataFrame:
    """Attach run settings: from the state table, else from the stored manifest."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(RUN, F.struct(*fields).alias(tag))

    joined = results.join(side(state, "_state"), RUN, "left").join(side(stored, "_file"), RUN, "left")
    chosen = F.coalesce("_state", "_file")
    source = F.when(F.col("_state").isNotNull(), "state").when(F.col("_file").isNotNull(), "file").otherwise("missing")
    return (
        joined.withColumn("manifest_source", source)
        .select("*", *[chosen[f].alias(f) for f in fields])
        .drop("_state", "_file")
    )


def missing_cases(dispatched: DataFrame, results: DataFrame) -> DataFrame:
    """Dispatched cases without a result; redelivered results collapse before the join."""
    return dispatched.join(results.select(RUN, "case_id").distinct(), [RUN, "case_id"], "left_anti")


def latest_status(events: DataFrame, order: list[str]) -> DataFrame:
    """Last status of every run from the append-only event log."""
    return latest_by(events, [RUN], order)


def mark_late(results: DataFrame, gates: DataFrame, arrived: str = "ts") -> DataFrame:
    """Add gated_at and late: the result came after its run was gated."""
    joined = results.join(gates.select(RUN, "gated_at"), RUN, "left")
    return joined.withColumn("late", F.coalesce(F.col(arrived) > F.col("gated_at"), F.lit(False)))


def late_policy(late: DataFrame, force: Column | None = None) -> DataFrame:
    """Late results are kept apart; only a forced run is gated again."""
    forced = F.coalesce(force if force is not None else F.lit(False), F.lit(False))
    return late.withColumn("outcome", F.when(~F.col("late"), "on_time").when(forced, "regate").otherwise("late_result"))


def dead_letters(failures: DataFrame, keys: list[str], max_receives: int = RESULT_MAX_RECEIVES) -> DataFrame:
    """Messages that failed at least ``max_receives`` times."""
    counted = failures.groupBy(*keys).agg(F.count("*").alias("attempts"))
    return counted.filter(F.col("attempts") >= max_receives)
