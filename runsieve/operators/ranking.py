"""Positions, latest rows and percentiles that hold when one key is hot.

None of these sorts a whole key in one task: positions come from a range
partitioning of all rows, latest rows from a partial aggregate, percentiles from
value buckets whose offsets are added up first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from runsieve.session import shared_dir

VALUE_BUCKETS = 65536


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def with_position(df: DataFrame, group: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """Add the 0-based position of each row within its group.

    ``order`` must be a total order within the group. Rows are range-partitioned
    by (group, order), so a group of any size spreads over many tasks; a row's
    position is its index in its partition plus the rows of the group in the
    partitions before it.
    """
    ranged = (
        df.repartitionByRange(*group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_part", F.spark_partition_id())
    )
    ranged = materialise(ranged)
    pieces = ranged.groupBy(*group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    keys = [*group, "_part"]
    offsets = offsets.withColumnsRenamed({c: f"_key_{c}" for c in keys})
    # Null-safe, so that rows with a NULL group keep their place.
    joined = ranged.join(offsets, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in keys])
    return joined.withColumn(name, F.col("_before") + F.col("_row") - F.col("_first")).drop(
        "_row", "_first", "_before", "_part", *[f"_key_{c}" for c in keys]
    )


def latest_by(df: DataFrame, keys: list[str], order: list[str], payload: list[str] | None = None) -> DataFrame:
    """Keep, per key, the row that is last by ``order`` (a total order).

    ``max_by`` combines on the map side, so a hot key costs one row per task.
    """
    payload = payload if payload is not None else [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*payload), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*")


def weighted_ranks(
    hist: DataFrame, group: list[str], value: str, weight: str, attach: DataFrame | None = None
) -> DataFrame:
    """Add ``_before`` (rows of the group below this value) and ``_total``.

    ``hist`` holds one row per (group, value) with its number of rows. Values in
    [0, 1] are cut into fixed-width buckets; only bucket totals are added up per
    group (at most 65,537 rows), and the running sum inside a bucket is a window
    over that bucket alone. ``attach`` adds per-group columns while the rows are
    still few.
    """
    bucket = F.floor(F.col(value) * VALUE_BUCKETS)
    hist = hist.withColumn("_bucket", bucket)
    totals = hist.groupBy(*group, "_bucket").agg(F.sum(weight).alias("_n"))
    per_group = Window.partitionBy(*group)
    earlier = per_group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group,
        "_bucket",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_n").over(per_group).alias("_total"),
    )
    if attach is not None:
        offsets = offsets.join(attach, group)
    inside = (
        Window.partitionBy(*group, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        hist.join(offsets, [*group, "_bucket"])
        .withColumn("_before", F.col("_offset") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .drop("_bucket", "_offset")
    )


def value_at(rank: Column, value: str, weight: str) -> Column:
    """Aggregate over ranked rows: the value that covers a 0-based rank."""
    covers = (F.col("_before") <= rank) & (rank < F.col("_before") + F.col(weight))
    return F.max(F.when(covers, F.col(value)))


def percentile_parts(pct: float, value: str, weight: str) -> tuple[Column, Column]:
    """The two neighbours of the linear-interpolation rank ``(n - 1) * pct``."""
    rank = (F.col("_total") - 1) * F.lit(pct)
    return value_at(F.floor(rank), value, weight), value_at(F.ceil(rank), value, weight)


def interpolate(low: Column, high: Column, n: Column, pct: float) -> Column:
    rank = (n - 1) * F.lit(pct)
    share = rank - F.floor(rank)
    return F.when(F.floor(rank) == F.ceil(rank), low).otherwise(low * (F.lit(1.0) - share) + high * share)
