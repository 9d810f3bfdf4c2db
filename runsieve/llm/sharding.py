"""Two-pass external shuffle into a fixed number of shards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsieve.llm.common import small_side, stored

SEED = 20
#: Text bytes that one bucket of the second pass should hold.
BUCKET_BYTES = 4 << 20
#: Buckets that one task of the second pass takes, one after the other.
TASK_BUCKETS = 8


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8 for the id."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 8


def _draw(doc_id: Column, shard: int, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(seed), F.lit(shard), doc_id).alias("h"), F.lit(shard).alias("s"))


def shard_of(doc_id: Column, shards: int, seed: int = SEED) -> Column:
    """The shard with the highest hash of (seed, shard, id): one more shard takes rows only into itself."""
    draws = [_draw(doc_id, k, seed) for k in range(shards)]
    return (F.greatest(*draws) if shards > 1 else draws[0])["s"]


def _numbered(docs: DataFrame, cols: list[str]) -> DataFrame:
    """``docs`` with ``_nth``, which tells equal rows apart: 0 to their number less one.

    Only rows whose hash repeats are counted as whole rows and dealt out again from the count, so a row
    that makes up much of the table is one row until then.
    """
    digest = F.xxhash64(*cols)
    again = docs.groupBy(digest.alias("_d")).agg(F.count("*").alias("_m")).filter("_m > 1").select("_d")
    again = small_side(stored(again, "repeats"))
    if not again.take(1):
        return docs.withColumn("_nth", F.lit(0))
    told = docs.withColumn("_d", digest)
    once = told.join(again, "_d", "left_anti").select(*cols, F.lit(0).alias("_nth"))
    many = told.join(again, "_d", "left_semi").groupBy(*cols).agg(F.count("*").alias("_m"))
    return once.unionAll(many.select(*cols, F.explode(F.sequence(F.lit(0), F.col("_m").cast("int") - 1)).alias("_nth")))


def shuffle_into_shards(docs: DataFrame, shards: int = 24, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``docs`` plus ``shard`` and ``slot`` (gapless from 0 in its shard), as a written table.

    First pass: a seeded hash of the whole row scatters the records over buckets of about ``bucket_bytes``,
    many to a shard; the number of buckets and of tasks comes from the bytes of the whole table. Second pass:
    each bucket is put into a fixed order and permuted by Fisher-Yates (the built-in seeded ``shuffle``)
    and written. A slot is the place in the bucket plus the rows of the shard's earlier buckets. Neither
    files nor partitions of the input take part in a hash or order, so a table gives the same slots however
    it is laid out.

    The law is ``key``: id and shard count decide the shard, so rows that repeat an id, null ids
    included, share a shard, but their buckets differ by the rest of the row; equal rows are numbered. Null
    and empty texts count no bytes. Extra columns are kept; ``shard`` and ``slot`` are replaced. An empty
    table gives an empty one.
    """
    docs = docs.drop("shard", "slot")
    cols = docs.columns
    total = docs.agg(F.sum(size_of(F.col("text")))).first()[0] or 0
    per_shard = max(1, math.ceil(total / bucket_bytes / shards))
    tasks = max(1, math.ceil(total / bucket_bytes / TASK_BUCKETS))
    spread = F.xxhash64(F.lit(seed), *cols, "_nth")
    scattered = _numbered(docs, cols).select(
        F.struct(*[F.col(c) for c in cols]).alias("_row"),
        shard_of(F.col("doc_id"), shards, seed).alias("shard"),
        F.pmod(spread, F.lit(per_shard)).cast("int").alias("_bucket"),
        spread.alias("_at"),
    )
    # A fixed number of tasks, dealt by bucket and sorted, fixes the random numbers that each bucket draws.
    buckets = (
        scattered.repartition(tasks, "shard", "_bucket")
        .groupBy("shard", "_bucket")
        .agg(F.array_sort(F.collect_list(F.struct("_at", "_row")), _by_place).alias("_rows"))
        .sortWithinPartitions("shard", "_bucket")
        .select("shard", "_bucket", F.posexplode(F.shuffle("_rows", F.lit(seed))).alias("_pos", "_r"))
        .select("shard", "_bucket", "_pos", F.col("_r._row").alias("_row"))
    )
    written = stored(buckets, "buckets")
    counts = written.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")), "starts")
    placed = written.join(small_side(starts), ["shard", "_bucket"])
    return placed.select(
        *[F.col("_row")[c].alias(c) for c in cols], "shard", (F.col("_start") + F.col("_pos")).cast("bigint").alias("slot")
    )


def _by_place(a: Column, b: Column) -> Column:
    return F.when(a["_at"] < b["_at"], -1).when(a["_at"] > b["_at"], 1).otherwise(0)
