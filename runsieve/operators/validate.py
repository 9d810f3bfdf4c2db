"""Data checks as violation rows; valid rows stay untouched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsieve.functions.text import strip
from runsieve.schemas import EVAL_BACKENDS, EVAL_MODES, RUN_STATUSES, SUITES

# Allowed ranges of settings (inclusive; None is unbounded).
SETTING_RANGES = {
    "shard_id": (0, None),
    "shard_size": (1, 100),
    "queue_wait_seconds": (0, 20),
    "cases_per_worker": (1, None),
    "idle_exit_seconds": (10, None),
    "run_timeout_seconds": (60, None),
}
ENUMS = {"suite": SUITES, "eval_mode": EVAL_MODES, "eval_backend": EVAL_BACKENDS, "status": RUN_STATUSES}


def _rules(df: DataFrame, keys: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    """One row per (row, broken rule); rows without one vanish."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules]))
    return df.select(*keys, F.explode(broken).alias("violation"))


def case_violations(cases: DataFrame) -> DataFrame:
    """Broken rules of cases: (dataset_id, case_id, violation, n).

    ``blank_id`` and ``unknown_suite`` are per row; ``duplicate_id`` compares ids
    after stripping, within a dataset.
    """
    stripped = cases.withColumn("case_id", strip(F.col("case_id")))
    rows = _rules(
        stripped,
        ["dataset_id", "case_id"],
        [("blank_id", F.col("case_id") == ""), ("unknown_suite", ~F.col("suite").isin(*SUITES))],
    )
    per_row = rows.groupBy("dataset_id", "case_id", "violation").agg(F.count("*").alias("n"))
    repeated = (
        stripped.groupBy("dataset_id", "case_id")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > 1)
        .select("dataset_id", "case_id", F.lit("duplicate_id").alias("violation"), "n")
    )
    return per_row.unionByName(repeated)


def empty_datasets(datasets: DataFrame, cases: DataFrame) -> DataFrame:
    """Datasets without any case.

    The case side is made distinct first: a dataset's copies collapse on the map
    side, so one huge dataset does not land in one join task.
    """
    return datasets.join(cases.select("dataset_id").distinct(), "dataset_id", "left_anti").select(
        "dataset_id", F.lit("").alias("case_id"), F.lit("no_cases").alias("violation"), F.lit(0).cast("bigint").alias("n")
    )


def range_violations(df: DataFrame, keys: list[str], columns: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Values outside [low, high] (NULL and NaN count as outside)."""
    return _rules(
        df, keys, [(f"{c}_out_of_range", ~F.col(c).between(low, high) | F.isnan(F.col(c).cast("double"))) for c in columns]
    )


def setting_violations(settings: DataFrame, keys: list[str]) -> DataFrame:
    """Settings outside their allowed range, for the setting columns present."""
    rules = []
    for name, (low, high) in SETTING_RANGES.items():
        if name in settings.columns:
            bad = F.col(name) < low
            rules.append((f"{name}_out_of_range", bad if high is None else bad | (F.col(name) > high)))
    return _rules(settings, keys, rules)


def enum_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Values outside their enumeration, for the enumeration columns present."""
    rules = [(f"unknown_{c}", ~F.col(c).isin(*values)) for c, values in ENUMS.items() if c in df.columns]
    return _rules(df, keys, rules)
