"""Mix sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsieve.llm.common import small_side, stored

SEED = "mix-1"
#: Exponent on a source's share of bytes: 1 keeps the shares, 0 makes all sources equal.
TEMPERATURE = 0.5
#: Bytes of the mixture as a multiple of the bytes of the corpus.
EPOCHS = 1.0
#: A rate above this is drawn as a sum of independent parts, so that exp(-rate) stays exact enough.
PART_RATE = 16.0


def uniform(*key: Column) -> Column:
    """A number in [0, 1) with 52 bits from the md5 of the key parts (null parts count as empty)."""
    text = F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("")) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson(u: Column, rate: Column) -> Column:
    """The smallest k whose cumulative Poisson probability exceeds ``u``."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).cast("bigint").alias("k"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * rate / i
        grown = F.struct(p.alias("p"), (s["cdf"] + p).alias("cdf"), i.cast("bigint").alias("k"))
        return F.when(u >= s["cdf"], grown).otherwise(s)

    # Beyond this many terms the tail is below the 2**-52 grain of u.
    terms = F.ceil(rate + 10 * F.sqrt(rate) + 40).cast("int")
    return F.aggregate(F.sequence(F.lit(1), terms), start, step)["k"]


def source_rates(docs: DataFrame, temperature: float = TEMPERATURE, epochs: float = EPOCHS) -> DataFrame:
    """``(source, bytes, rate)``: mean repetitions that bring each source to its target weight.

    The weight of a source is its share of bytes to the power ``temperature``, over all sources.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")).alias("bytes"))
    sizes = stored(sizes, "sizes")
    whole = sizes.agg(F.sum("bytes")).first()[0] or 1
    weights = sizes.withColumn("w", F.when(F.col("bytes") > 0, F.pow(F.col("bytes") / F.lit(float(whole)), F.lit(temperature))).otherwise(0.0))
    mass = weights.agg(F.sum("w")).first()[0] or 1.0
    rate = F.lit(epochs) * F.col("w") / F.lit(mass) * F.lit(float(whole)) / F.col("bytes")
    return weights.select("source", "bytes", F.when(F.col("bytes") > 0, rate).otherwise(F.lit(epochs)).alias("rate"))


def mix(docs: DataFrame, rates: DataFrame | None = None, seed: str = SEED) -> DataFrame:
    """All columns of ``docs`` plus ``copy`` (from 0): each document as often as its Poisson draw says, in
    a global random order.

    ``rates`` has one row per source with its ``rate``; by default that of ``source_rates``. The draw of a
    document inverts the Poisson distribution of its source's rate at a uniform number hashed from seed
    and id, so it does not depend on partitions or retries. Copies are dealt by range of a second hash of
    (seed, id, copy) and sorted, which is the global shuffle; no source or key gathers in a task.

    Null and empty texts are documents; a null source is a source; a source without a rate is dropped; a
    source of empty texts has the rate ``EPOCHS``. Rows that repeat an id get the same draw. Extra columns
    are kept, ``copy`` is replaced. An empty table gives an empty one.
    """
    docs = docs.drop("copy")
    rates = stored(source_rates(docs) if rates is None else rates, "rates").select(F.col("source").alias("_s"), F.col("rate").alias("_rate"))
    parts = F.greatest(F.ceil(F.col("_rate") / PART_RATE), F.lit(1)).cast("int")
    draws = F.transform(
        F.sequence(F.lit(1), parts), lambda i: poisson(uniform(F.lit(seed), F.col("doc_id"), i), F.col("_rate") / parts)
    )
    count = F.aggregate(draws, F.lit(0).cast("bigint"), lambda a, d: a + d)
    drawn = docs.join(small_side(rates), F.col("source").eqNullSafe(F.col("_s"))).withColumn("_n", count.cast("int"))
    copies = drawn.filter("_n > 0").select(*docs.columns, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("copy"))
    return copies.orderBy(F.xxhash64(F.lit(seed), "doc_id", "copy"), "doc_id", "copy")
