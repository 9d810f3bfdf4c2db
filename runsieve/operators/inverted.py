"""A stored inverted index of passages and exact lexical top-k by bounds, for corpora that outgrow one pass per query block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from runsieve.functions.text import alnum_tokens, shared_count

#: Bands of passage size per doubling: all passages of a band score alike within 2 ** (1 / (2 * BANDS)).
BANDS = 4
#: Postings of one token in one band above which they are split by passage.
HOT_POSTINGS = 65_536
#: Bytes of a side that may be broadcast; a larger one joins by a shuffle.
BROADCAST_BYTES = 32_000_000
#: Seed postings per query and wanted passage, so that copies among them still leave k passages.
SEED_FACTOR = 8
#: Keeps the least overlap on the safe side of rounding.
_SLACK = 1e-9


def _checked(df: DataFrame, text: Column | None = None) -> DataFrame:
    """Mark a stored side for broadcast if its rows, and the bytes of their text, add up to little."""
    size = F.lit(64) if text is None else F.octet_length(text) + 64
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _band(n: Column) -> Column:
    return F.floor(F.log2(n) * BANDS).cast("int")


class PassageIndex:
    """Tables of an index in a folder: passages (id, tokens, n, band), postings (token, band, part, id), terms
    (token, band, df, parts) and bands (band, least n)."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self.passages, self.postings, self.terms, self.bands = (
            spark.read.parquet(f"{self.path}/{t}") for t in ("passages", "postings", "terms", "bands")
        )


def build_index(passages: DataFrame, path: str, hot: int = HOT_POSTINGS) -> PassageIndex:
    """Index ``passages`` (passage_id, text; ids are unique) into a new folder.

    A passage is put into a band by its number of tokens. Postings are flat rows in ranges of (token, band,
    part, id), so a token of every passage is many ranges and files skip by their bounds; the
    parts of a frequent token say how a join on it is split. Passages without tokens and null texts are left out.
    """
    path, spark = path.rstrip("/"), passages.sparkSession
    rows = passages.select("passage_id", alnum_tokens(F.col("text")).alias("tokens")).withColumn("n", F.size("tokens"))
    rows = _stored(rows.filter("n > 0").withColumn("band", _band(F.col("n"))), f"{path}/passages")
    _stored(rows.groupBy("band").agg(F.min("n").alias("least_n")), f"{path}/bands")
    flat = rows.select(F.explode("tokens").alias("token"), "band", "passage_id")
    counted = flat.groupBy("token", "band").agg(F.count("*").alias("df"))
    terms = _stored(counted.withColumn("parts", F.ceil(F.col("df") / hot).cast("int")), f"{path}/terms")
    split = _checked(terms.filter("parts > 1").select("token", "band", "parts"), F.col("token"))
    part = F.pmod(F.xxhash64("passage_id"), F.coalesce("parts", F.lit(1))).cast("int")
    postings = flat.join(split, ["token", "band"], "left").select("token", "band", part.alias("part"), "passage_id")
    _stored(postings.repartitionByRange("token", "band", "part", "passage_id").sortWithinPartitions("token", "band", "part"), f"{path}/postings")
    return PassageIndex(spark, path)


def _found(index: PassageIndex, wanted: DataFrame) -> DataFrame:
    """Distinct (query, passage) of the wanted (query, token, band, parts); a split token meets part by part."""
    parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    asked = wanted.select("query_id", "token", "band", parts)
    return asked.join(index.postings, ["token", "band", "part"]).select("query_id", "passage_id").distinct()


def _scored(index: PassageIndex, pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """Exact scores of pairs: shared tokens / sqrt(passage tokens)."""
    texts = index.passages.select("passage_id", F.col("tokens").alias("_p"), "n")
    both = pairs.join(asked.select("query_id", F.col("tokens").alias("_q")), "query_id").join(texts, "passage_id")
    return both.select("query_id", "passage_id", (shared_count(F.col("_q"), F.col("_p")) / F.sqrt(F.col("n").cast("double"))).alias("score"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "passage_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def open_requests(terms_of: DataFrame, bands: DataFrame, limits: DataFrame) -> DataFrame:
    """The (query, token, band) whose postings can still hold a passage of the best k.

    A passage of a band with at least ``n`` tokens needs ``m`` = limit * sqrt(n) shared tokens to reach the limit
    of its query. If the band holds ``t`` of the query's tokens, it is skipped for t < m; else such a passage
    has one of the t - m + 1 rarest of them, and only those are asked for.
    """
    least = F.greatest(F.lit(1), F.ceil(F.coalesce("limit", F.lit(0.0)) * F.sqrt(F.col("least_n").cast("double")) - _SLACK))
    rows = terms_of.join(F.broadcast(bands), "band").join(limits, "query_id", "left").withColumn("_m", least)
    here = Window.partitionBy("query_id", "band")
    rows = rows.withColumn("_t", F.count("*").over(here)).withColumn("_i", F.row_number().over(here.orderBy("df", "token")))
    return rows.filter("_i <= _t - _m + 1").select("query_id", "token", "band", "parts")


def indexed_top_k(index: PassageIndex, queries: DataFrame, work: str, k: int = 4) -> DataFrame:
    """Best ``k`` passages (query_id, passage_id, score, rank) of every query, scores above 0, ties by id.

    Two rounds with intermediate tables in the new folder ``work``. The first takes the postings of each query's rarest
    tokens, smallest passages first, until they are ``SEED_FACTOR * k``; the k-th best exact score among them
    is the query's limit (0 with fewer passages). The second asks only for what can reach that limit
    (``open_requests``) and scores whole token sets. So the work follows the rare tokens of a query, no
    row of queries or passages goes through the driver, and a token of every passage is met in parts. A query of
    common tokens alone, whose limit is low, still reads their postings in the bands that can reach it.

    Query ids are unique. Null texts, and texts without tokens, have no result; so has an empty table.
    """
    work = work.rstrip("/")
    asked = queries.select("query_id", alnum_tokens(F.col("query")).alias("tokens")).filter(F.size("tokens") > 0)
    asked = _stored(asked, f"{work}/queries")
    asked = _checked(asked, F.array_join("tokens", " "))
    terms_of = asked.select("query_id", F.explode("tokens").alias("token")).join(index.terms, "token")
    terms_of = _stored(terms_of, f"{work}/terms")

    whole = terms_of.groupBy("query_id", "token").agg(F.sum("df").alias("total"))
    in_order = Window.partitionBy("query_id").orderBy("total", "token", "band").rowsBetween(Window.unboundedPreceding, -1)
    seeds = terms_of.join(whole, ["query_id", "token"]).withColumn("_before", F.coalesce(F.sum("df").over(in_order), F.lit(0)))
    seeds = _stored(_scored(index, _found(index, seeds.filter(F.col("_before") < SEED_FACTOR * k)), asked), f"{work}/seeds")

    limits = _stored(_best(seeds, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("limit")), f"{work}/limits")
    more = _found(index, open_requests(terms_of, index.bands, _checked(limits)))
    rest = more.join(seeds.select("query_id", "passage_id"), ["query_id", "passage_id"], "left_anti")
    return _best(_scored(index, rest, asked).unionByName(seeds), k)
