"""Dataset manifests and run state kept in keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsieve.functions.text import or_str
from runsieve.operators.ranking import latest_by
from runsieve.schemas import DATASET_MANIFEST, RUN_DEFAULTS, RUN_MANIFEST, RUN_STATUSES, THRESHOLDS, Thresholds, column_list


def manifest_items(manifests: DataFrame) -> DataFrame:
    """Manifest rows as stored: attributes plus the whole row as JSON."""
    return manifests.filter(or_str(F.col("dataset_id")).isNotNull()).withColumn(
        "payload", F.to_json(F.struct(*[f.name for f in DATASET_MANIFEST.fields if f.name in manifests.columns]))
    )


def latest_manifests(items: DataFrame, order: list[str]) -> DataFrame:
    """Last write of every dataset, read from its payload.

    Items without a payload fall back to their attributes with defaults.
    """
    attributes = ["git_sha", "s3_uri", "version", "name", "case_count", "payload"]
    last = latest_by(items.filter(or_str(F.col("dataset_id")).isNotNull()), ["dataset_id"], order, attributes)
    p = F.from_json("payload", DATASET_MANIFEST)
    return last.withColumn("_p", p).select(
        "dataset_id",
        F.when(F.col("payload").isNotNull(), F.col("_p.git_sha")).otherwise(or_str(F.col("git_sha"))).alias("git_sha"),
        F.when(F.col("payload").isNotNull(), F.col("_p.s3_uri")).otherwise(F.col("s3_uri")).alias("s3_uri"),
        F.coalesce(F.when(F.col("payload").isNotNull(), F.col("_p.version")).otherwise(or_str(F.col("version"))), F.lit("1.0")).alias("version"),
        F.coalesce(F.when(F.col("payload").isNotNull(), F.col("_p.name")).otherwise(or_str(F.col("name"))), F.lit("golden")).alias("name"),
        F.coalesce(F.when(F.col("payload").isNotNull(), F.col("_p.case_count")).otherwise(F.col("case_count")), F.lit(0)).alias("case_count"),
    )


def run_items(runs: DataFrame) -> DataFrame:
    """Run rows as stored: counters and status beside the whole row as JSON."""
    return runs.withColumn("payload", F.to_json(F.struct(*[f.name for f in RUN_MANIFEST.fields if f.name in runs.columns])))


def decode_runs(items: DataFrame) -> DataFrame:
    """Run rows from stored items.

    The item's own counters and status win over its payload; an unknown status
    keeps the payload's; an item without a payload gets ``decode_error``. All fields
    of ``RUN_MANIFEST`` are read; absent settings and thresholds take their defaults.
    """
    p = F.col("_p")
    known = F.when(F.col("status").isin(*RUN_STATUSES), F.col("status"))
    decoded = items.withColumn("_p", F.from_json("payload", RUN_MANIFEST))
    limits = Thresholds()
    values = {
        "eval_run_id": F.col("eval_run_id"),
        "status": F.coalesce(known, p["status"]),
        "completed_shards": F.coalesce("completed_shards", p["completed_shards"]),
        "completed_cases": F.coalesce("completed_cases", p["completed_cases"]),
        "thresholds": F.struct(
            *[F.coalesce(p["thresholds"][n], F.lit(getattr(limits, n))).alias(n) for n in column_list(THRESHOLDS)]
        ),
        **{name: F.coalesce(p[name], F.lit(default)) for name, default in RUN_DEFAULTS.items()},
    }
    return decoded.select(
        *[values.get(n, p[n]).alias(n) for n in column_list(RUN_MANIFEST)],
        F.when(F.col("payload").isNull(), F.lit("item has no payload")).alias("decode_error"),
    )
