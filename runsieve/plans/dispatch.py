"""Trigger events to runs, shards and jobs, with what is refused kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsieve.functions.text import or_str
from runsieve.operators import dispatch as ops
from runsieve.operators.gate import iso_text
from runsieve.operators.validate import case_violations
from runsieve.schemas import EVAL_BACKENDS, EVAL_MODES, SHARD_SIZE, Thresholds
from runsieve.sources.triggers import normalise_triggers

RUN = "eval_run_id"
SETTINGS = {"eval_mode": "candidate", "eval_backend": "deepeval", "judge_model_id": None, "candidate_model_id": None, "agent_endpoint": None}


def checked_sets(datasets: DataFrame, cases: DataFrame) -> DataFrame:
    """(dataset_id, n_cases, version, dataset_name, violations): the kinds of broken rules of each set.

    ``datasets`` names all sets that were read; one without cases has the violation ``no_cases``. At most
    one row per set and kind of violation meets the others.
    """
    sizes = cases.groupBy("dataset_id").agg(
        F.count("*").alias("n_cases"), F.max("version").alias("version"), F.max("dataset_name").alias("dataset_name")
    )
    broken = case_violations(cases).groupBy("dataset_id").agg(F.sort_array(F.collect_set("violation")).alias("_broken"))
    known = datasets.select("dataset_id").distinct().join(sizes, "dataset_id", "left").join(broken, "dataset_id", "left")
    found = F.when(F.col("n_cases").isNull(), F.array(F.lit("no_cases"))).otherwise(F.coalesce("_broken", F.array().cast("array<string>")))
    return known.withColumn("violations", found).drop("_broken")


def dispatch_runs(
    events: DataFrame,
    manifests: DataFrame,
    datasets: DataFrame,
    cases: DataFrame,
    started: Column,
    conf: dict[str, str] | None = None,
    default_bucket: str = "",
    thresholds: Thresholds | None = None,
    size: int = SHARD_SIZE,
) -> dict[str, DataFrame]:
    """Tables ``runs`` (manifests to store), ``cases`` (sharded), ``jobs``, ``manifests`` (to add) and ``rejected``.

    ``events`` has JSON in ``event``; ``manifests`` are known data-set manifests; ``cases`` are rows of
    ``case_rows`` whose dataset_id is the uri of the set, all of them listed in ``datasets``. A trigger
    without a data set, with an unknown mode or backend, or on a set that is missing or breaks a rule is
    rejected whole, with its reason. A trigger that is delivered again is one run; different triggers with one
    run id are rejected, so run, case and job ids are unique. Positions come from the
    sets, so nothing is sorted; cases meet their runs by an equi-join on the set.
    """
    conf = conf or {}
    asked = normalise_triggers(events).withColumn("dataset_name", F.lit(None).cast("string"))
    asked = asked.withColumn("dataset_bucket", F.coalesce(or_str(F.col("dataset_bucket")), F.lit(default_bucket)))
    ready = ops.resolve_settings(asked, conf, SETTINGS)
    placed = ops.resolve_datasets(ready, manifests).select(
        "eval_run_id", "dataset_uri", "manifest_id", "insert_manifest", "error", *SETTINGS, "repo", "git_sha", "pr_number", "check_run_id",
    ).distinct()
    sets = checked_sets(datasets, cases).withColumnRenamed("dataset_id", "dataset_uri")
    sets = sets.withColumn("_read", F.lit(True))
    whole = placed.join(sets, "dataset_uri", "left")
    reason = F.coalesce(
        "error",
        F.when(~F.coalesce(F.col("eval_mode").isin(*EVAL_MODES), F.lit(False)), F.concat(F.lit("unknown mode "), "eval_mode")),
        F.when(~F.coalesce(F.col("eval_backend").isin(*EVAL_BACKENDS), F.lit(False)), F.concat(F.lit("unknown backend "), "eval_backend")),
        F.when(F.col("_read").isNull(), F.lit("the data set was not found")),
        F.when(F.size("violations") > 0, F.concat(F.lit("invalid data set: "), F.array_join("violations", ", "))),
    )
    told_apart = ("dataset_uri", "manifest_id", *SETTINGS, "repo", "git_sha", "pr_number", "check_run_id")
    made = ops.run_id(started, *[F.col(c) for c in told_apart])
    whole = whole.withColumn("reason", reason).withColumn(RUN, F.coalesce(or_str(F.col(RUN)), made))
    # One id is one run: triggers that differ and still have one id, stated or by hash, are all refused.
    several = whole.filter("reason IS NULL").groupBy(RUN).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(RUN).alias("_run"), F.lit(True).alias("_shared"))
    whole = whole.join(several, F.col(RUN) == F.col("_run"), "left").drop("_run")
    clash = F.when(F.col("_shared"), F.lit("other triggers have the same run id"))
    whole = whole.withColumn("reason", F.coalesce("reason", clash)).drop("_shared")
    whole = whole.withColumn("manifest_id", F.coalesce("manifest_id", "dataset_name"))
    good = whole.filter("reason IS NULL")
    runs = good.select(
        RUN, F.lit("running").alias("status"), F.col("dataset_uri").alias("dataset_s3_uri"), F.col("version").alias("dataset_version"),
        "dataset_name", F.col("manifest_id").alias("dataset_manifest_id"), F.col("n_cases").alias("total_cases"),
        F.ceil(F.col("n_cases") / size).cast("bigint").alias("total_shards"), F.lit(0).cast("bigint").alias("completed_shards"),
        F.lit(0).cast("bigint").alias("completed_cases"), *SETTINGS,
        F.struct(
            F.coalesce(or_str(F.col("repo")), F.lit(conf.get("repo") or None).cast("string")).alias("repo"), "pr_number", "git_sha", "check_run_id",
            F.lit(None).cast("bigint").alias("installation_id"),
        ).alias("source"),
        (thresholds or Thresholds()).as_column().alias("thresholds"), iso_text(started).alias("created_at"), iso_text(started).alias("updated_at"),
    )
    mine = good.select(RUN, F.col("dataset_uri").alias("dataset_id")).join(cases, "dataset_id")
    sharded = ops.assign_shards(mine, size=size)
    settings = runs.select(RUN, *SETTINGS, "dataset_manifest_id", "source")
    added = good.filter("insert_manifest").select(
        F.col("manifest_id").alias("dataset_id"), "git_sha", F.col("dataset_uri").alias("s3_uri"), "version",
        F.col("dataset_name").alias("name"), F.col("n_cases").alias("case_count"), iso_text(started).alias("created_at"),
    )
    rejected = whole.filter("reason IS NOT NULL").select(RUN, "dataset_uri", "reason", iso_text(started).alias("rejected_at"))
    return {"runs": runs, "cases": sharded, "jobs": ops.shard_jobs(sharded, settings), "manifests": added.distinct(), "rejected": rejected}
