"""Shard layout: cases on disk so that one shard reads few bytes.

A directory per shard would mean one per eight cases, and one per run would mean millions of small ones.
Directories hold a hash bucket of runs and a block of shards; rows are sorted by run and shard inside, so
a shard filter prunes directories and then row groups. Every dispatch appends with its own number. When its
cases are all there it appends a pointer (run, dispatch) to a small table beside the store; readers take
the last pointer of each run, so a shorter dispatch leaves no old shard behind and a broken one is not seen.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS_PER_BLOCK = 1024
RUN_BUCKETS = 256


def block_of(shard_id: Column) -> Column:
    return F.floor(shard_id / F.lit(SHARDS_PER_BLOCK))


def run_bucket(run: Column) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(RUN_BUCKETS)).cast("int")


def _pointer_path(path: str) -> str:
    return path.rstrip("/") + ".dispatches"


def write_shards(cases: DataFrame, path: str, dispatch: int | None = None) -> None:
    """Append sharded cases under a dispatch number (by default the time in microseconds).

    The runs of ``cases`` are evaluated once more for the pointers, so their ids must not change between reads.
    """
    number = dispatch if dispatch is not None else time.time_ns() // 1000
    blocked = (
        cases.withColumn("shard_block", block_of(F.col("shard_id")).cast("bigint"))
        .withColumn("run_bucket", run_bucket(F.col("eval_run_id")))
        .withColumn("dispatch", F.lit(number).cast("bigint"))
    )
    (
        blocked.repartition("eval_run_id", "shard_block")
        .sortWithinPartitions("run_bucket", "shard_block", "eval_run_id", "shard_id", "pos")
        .write.mode("append")
        .partitionBy("run_bucket", "shard_block")
        .parquet(path)
    )
    pointers = blocked.select("eval_run_id", "dispatch", "run_bucket").distinct()
    pointers.repartition("run_bucket").write.mode("append").partitionBy("run_bucket").parquet(_pointer_path(path))


def _last(spark: SparkSession, path: str, within: Column | None = None, buckets: Column | None = None) -> DataFrame:
    """Rows of the last finished dispatch of each run; ``within`` and ``buckets`` limit the directories of cases
    and of pointers that are read."""
    rows, pointers = spark.read.parquet(path), spark.read.parquet(_pointer_path(path))
    if within is not None:
        rows, pointers = rows.filter(within), pointers.filter(buckets)
    last = pointers.groupBy("eval_run_id").agg(F.max("dispatch").alias("dispatch"))
    return rows.join(last, ["eval_run_id", "dispatch"]).drop("dispatch", "run_bucket")


def read_shards(spark: SparkSession, path: str, jobs: DataFrame | None = None) -> DataFrame:
    """All shards, or those of the given jobs (eval_run_id, shard_id). Ids keep the type they had.

    The jobs are counted down to the span of blocks in each bucket of runs, at most ``RUN_BUCKETS`` rows, and only the
    directories in these spans are read. Jobs with a null id have no shard.
    """
    if jobs is None:
        return _last(spark, path)
    kind = spark.read.parquet(path).schema["eval_run_id"].dataType
    wanted = jobs.select(F.col("eval_run_id").cast(kind).alias("eval_run_id"), "shard_id").dropna().distinct()
    spans = wanted.groupBy(run_bucket(F.col("eval_run_id")).alias("b")).agg(
        F.min(block_of(F.col("shard_id"))).cast("bigint").alias("lo"), F.max(block_of(F.col("shard_id"))).cast("bigint").alias("hi")
    )
    within, buckets = F.lit(False), []
    for b, lo, hi in spans.collect():
        within = within | ((F.col("run_bucket") == b) & F.col("shard_block").between(lo, hi))
        buckets.append(b)
    return _last(spark, path, within, F.col("run_bucket").isin(buckets)).join(wanted, ["eval_run_id", "shard_id"])


def read_shard(spark: SparkSession, path: str, run: str, shard_id: int) -> DataFrame:
    """One shard: the last dispatch of the run is looked up in the run's bucket alone."""
    bucket = F.col("run_bucket") == run_bucket(F.lit(run))
    block = (F.col("shard_block") == shard_id // SHARDS_PER_BLOCK) & (F.col("shard_id") == shard_id)
    return _last(spark, path, bucket & (F.col("eval_run_id") == run) & block, bucket & (F.col("eval_run_id") == run))
