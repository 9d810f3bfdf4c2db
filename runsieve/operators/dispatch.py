"""From datasets to runs, shards and shard jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsieve.functions.text import or_str
from runsieve.operators.ranking import with_position
from runsieve.schemas import SHARD_SIZE

_BATCH = 10  # fixed value: jobs per transport batch
_DEDUP_CHARS = 128  # fixed value: longest transport dedup id


def shard_of(pos: Column, size: int = SHARD_SIZE) -> Column:
    """Contiguous shard number of a 0-based position."""
    if size < 1:
        raise ValueError("shard size must be at least 1")
    return F.floor(pos / F.lit(size))


def assign_shards(cases: DataFrame, order: list[str] | None = None, size: int = SHARD_SIZE) -> DataFrame:
    """Add shard_id and batch_id from ``pos``, which is derived from ``order`` if given."""
    if order is not None:
        cases = with_position(cases, ["eval_run_id"], order)
    return cases.withColumn("shard_id", shard_of(F.col("pos"), size)).withColumn(
        "batch_id", F.floor(F.col("shard_id") / F.lit(_BATCH))
    )


def shard_label(shard_id: Column) -> Column:
    """Shard number padded to four digits; longer numbers are kept whole."""
    text = shard_id.cast("string")
    return F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text)


def group_id(run: Column, shard_id: Column) -> Column:
    return F.concat(run, F.lit("-"), shard_label(shard_id))


def dedup_id(run: Column, shard_id: Column) -> Column:
    return F.concat(run, F.lit("-shard-"), shard_label(shard_id))


def transport_id(identifier: Column) -> Column:
    return F.substring(identifier, 1, _DEDUP_CHARS)


def result_dedup_id(run: Column, shard_id: Column) -> Column:
    return F.concat(dedup_id(run, shard_id), F.lit("-result"))


def marked(value: Column) -> Column:
    """A value as text that no neighbour can be taken for part of."""
    text = value.cast("string")
    return F.when(text.isNull(), "-;").otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text, F.lit(";")))


def run_id(started: Column, *inputs: Column) -> Column:
    """``eval-<UTC stamp>-<8 hex>``; the suffix is a hash of the inputs, not random. Each input counts with its
    length, and a missing one differs from an empty one."""
    stamp = F.date_format(started, "yyyyMMdd'T'HHmmss'Z'")
    return F.concat(F.lit("eval-"), stamp, F.lit("-"), F.substring(F.sha2(F.concat(*[marked(c) for c in inputs]), 256), 1, 8))


def run_paths(run: Column, shard_id: Column) -> dict[str, Column]:
    """Object keys of a run's files."""
    root = F.concat(F.lit("runs/"), run, F.lit("/"))
    return {
        "shard_key": F.concat(root, F.lit("shards/"), shard_label(shard_id), F.lit(".json")),
        "result_key": F.concat(root, F.lit("results/shard-"), shard_label(shard_id), F.lit(".json")),
        "manifest_key": F.concat(root, F.lit("manifest.json")),
        "report_key": F.concat(root, F.lit("report.json")),
    }


def shard_jobs(sharded: DataFrame, settings: DataFrame) -> DataFrame:
    """One job row per shard: case ids in case order plus the run's settings.

    A shard holds at most ``size`` cases, so its list is bounded.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "case_id"))), lambda s: s["case_id"])
    jobs = sharded.groupBy("eval_run_id", "shard_id", "batch_id").agg(ordered.alias("case_ids"))
    return (
        jobs.join(settings, "eval_run_id")
        .withColumn("group_id", group_id(F.col("eval_run_id"), F.col("shard_id")))
        .withColumn("dedup_id", dedup_id(F.col("eval_run_id"), F.col("shard_id")))
        .withColumn("shard_key", run_paths(F.col("eval_run_id"), F.col("shard_id"))["shard_key"])
    )


def dispatch_totals(sharded: DataFrame) -> DataFrame:
    return sharded.groupBy("eval_run_id").agg(
        F.count("*").alias("total_cases"), (F.max("shard_id") + 1).alias("total_shards")
    )


def resolve_settings(requests: DataFrame, conf: dict[str, str], defaults: dict[str, str | None]) -> DataFrame:
    """Setting by setting: request, then configuration, then default.

    ``conf`` is a mapping of setting names to values; empty values do not count.
    """
    chosen = {}
    for name, default in defaults.items():
        fallback = F.lit(conf.get(name) or default).cast("string")
        chosen[name] = F.coalesce(or_str(F.col(name)), fallback) if name in requests.columns else fallback
    return requests.withColumns(chosen)


def resolve_datasets(triggers: DataFrame, manifests: DataFrame) -> DataFrame:
    """Add the dataset's uri, its manifest id and where it came from.

    A stored manifest wins over the trigger's own bucket and key; with neither
    the row gets an error. ``insert_manifest`` marks manifests to be added.
    Triggers need dataset_id, git_sha, dataset_name, dataset_bucket, dataset_key.
    """
    stored = manifests.select(
        F.col("dataset_id"), F.col("s3_uri").alias("_stored_uri"), F.lit(True).alias("_known")
    )
    joined = triggers.join(stored, "dataset_id", "left")
    known = F.coalesce(F.col("_known"), F.lit(False))
    has_key = or_str(F.col("dataset_key")).isNotNull()
    direct = F.concat(F.lit("s3://"), F.col("dataset_bucket"), F.lit("/"), F.col("dataset_key"))
    return (
        joined.withColumn("dataset_uri", F.when(known, F.col("_stored_uri")).when(has_key, direct))
        .withColumn(
            "manifest_id",
            F.when(known, F.col("dataset_id")).when(has_key, or_str(F.col("dataset_id"), F.col("git_sha"), F.col("dataset_name"))),
        )
        .withColumn("insert_manifest", ~known & has_key)
        .withColumn("error", F.when(~known & ~has_key, F.lit("a dataset key or a known dataset id is required")))
        .drop("_stored_uri", "_known")
    )
