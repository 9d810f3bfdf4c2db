"""Reports that follow late and redelivered shards: stored exact partials per (run, shard), gated again by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsieve.operators.ranking import materialise
from runsieve.plans.evaluate import reports_from_histogram
from runsieve.schemas import Thresholds
from runsieve.sources.keyed import KeyedTable

RUN = "eval_run_id"
SHARD = [RUN, "shard_id"]
PARTIALS = (
    "eval_run_id string, shard_id string, "
    "counts array<struct<metric:string,score:double,c:bigint,input_tokens:bigint,output_tokens:bigint>>"
)
_SUMS = ("c", "input_tokens", "output_tokens")


def partials_table(spark: SparkSession, path: str, buckets: int = 16) -> KeyedTable:
    """The stored partials, one row per shard; all shards of a run share a bucket."""
    return KeyedTable(spark, path, PARTIALS, tuple(SHARD), (RUN,), buckets)


def shard_partials(facts: DataFrame) -> DataFrame:
    """Facts (with their shard) as one row per shard: how often each metric had each score, and its tokens.

    A shard is a fixed number of cases, so its list of counts is short; facts are counted before they are listed.
    """
    counted = facts.groupBy(*SHARD, "metric", "score").agg(
        F.count("*").alias("c"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS[1:]]
    )
    listed = F.collect_list(F.struct("metric", "score", *_SUMS)).alias("counts")
    return counted.groupBy(*SHARD).agg(listed)


def deliver(table: KeyedTable, facts: DataFrame, writer: str | None = None, batch_id: int | None = None) -> int:
    """Store the delivered shards; the version that holds them.

    ``facts`` hold every fact of the shards in them. A shard that comes again takes the place of its former
    delivery, which thereby leaves all sums; a replayed batch of ``writer`` changes nothing.
    """
    return table.upsert(shard_partials(facts), writer=writer, batch_id=batch_id)


def regate(table: KeyedTable, runs: DataFrame, thresholds: Thresholds | None = None, version: int | None = None) -> DataFrame:
    """Reports of the runs in ``runs`` from their partials alone; the files of other buckets are not read.

    ``runs`` is as in ``build_reports``. Counts of shards are added, so means, ranks and rates are those of
    all facts, in whatever order the shards came.
    """
    counts = table.lookup(runs.select(RUN), version).select(RUN, F.explode("counts").alias("_p")).select(RUN, "_p.*")
    hist = counts.groupBy(RUN, "metric", "score").agg(*[F.sum(c).alias(c) for c in _SUMS])
    return reports_from_histogram(materialise(hist), runs, thresholds)
