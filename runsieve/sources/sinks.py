"""Idempotent writers."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runsieve.operators.ranking import latest_by


def _versioned(rows: DataFrame, version: int | None) -> DataFrame:
    """Rows with the number of their write: by default the time in microseconds."""
    return rows.withColumn("version", F.lit(version if version is not None else time.time_ns() // 1000).cast("bigint"))


def write_reports(reports: DataFrame, path: str, date_column: str = "run_date", version: int | None = None) -> None:
    """Append reports as JSON lines, partitioned by date; ``read_reports`` sees the last of each run, so a
    run replaces itself and no other.

    The rebalance hint gathers a date into few files and splits a date that is
    much larger than the others.
    """
    _versioned(reports, version).hint("rebalance", date_column).write.mode("append").partitionBy(date_column).json(path)


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last report of each run; ``schema`` lists the columns that were written."""
    rows = spark.read.schema(f"{schema}, version bigint").json(path)
    return latest_by(rows, ["eval_run_id"], ["version"]).drop("version")


def write_markdown(reports: DataFrame, path: str, version: int | None = None) -> None:
    """Append Markdown texts keyed by run, as Parquet (text with newlines)."""
    _versioned(reports.select("eval_run_id", "markdown"), version).write.mode("append").parquet(path)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """The last text of each run."""
    rows = spark.read.schema("eval_run_id string, markdown string, version bigint").parquet(path)
    return latest_by(rows, ["eval_run_id"], ["version"]).drop("version")


def compact(spark: SparkSession, path: str, schema: str, to: str, date_column: str = "run_date") -> None:
    """Rewrite a report log into a new folder with the last report of each run only."""
    write_reports(read_reports(spark, path, schema), to, date_column, version=0)


def append_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Write a micro-batch under its id; a replayed batch replaces itself."""
    (
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Everything appended so far; empty with the same schema before the first batch."""
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def current_rows(log: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Upsert view of an append-only log: last row per key by batch, then ``order``."""
    return latest_by(log, keys, ["batch_id", *(order or [])]).drop("batch_id")
