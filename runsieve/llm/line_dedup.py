"""Remove lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsieve.llm.common import BLANKS, ascii_lower, key_of, small_side, stored


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """All columns of ``docs`` plus ``n_lines``, ``n_dropped`` and ``kept_text``.

    A text is split at line feeds and each line is reduced to its key. Lines are exploded as (document,
    position, hash) without their text; the documents per hash are counted with partial aggregates; the
    positions of lines whose key occurs in at least ``min_docs`` documents go back to their documents,
    which are reassembled by position. Each text is shuffled once, to meet its positions, whatever the
    number of documents that lose lines.

    Null and empty texts are one empty line; an empty key is never dropped; a document that loses all
    lines keeps the empty text. Rows that repeat id and text are one document in the counts and each stay in the
    result; rows that repeat an id with another text are documents of their own. Extra
    columns are kept; ``n_lines``, ``n_dropped``, ``kept_text`` are replaced. An empty table gives an
    empty one.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select("doc_id", key_of(text).alias("_t"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).filter("key <> ''")
    # Two independent hashes: 128 bits tell lines apart at any size.
    hashes = F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g")
    lines = stored(lines.select("doc_id", "_t", "pos", *hashes), "lines")
    counts = lines.select("h", "g", "doc_id", "_t").distinct().groupBy("h", "g").agg(F.count("*").alias("n"))
    common = stored(counts.filter(F.col("n") >= min_docs).select("h", "g"), "common")
    drops = lines.join(small_side(common), ["h", "g"]).groupBy("doc_id", "_t").agg(F.collect_set("pos").alias("_drop"))
    drops = stored(drops.withColumnRenamed("doc_id", "_id").withColumnRenamed("_t", "_tt"), "drops")
    dropped = F.coalesce(F.col("_drop"), F.array().cast("array<int>"))
    out = docs.withColumn("_t", key_of(text)).join(
        drops.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_tt")), "left"
    )
    parts = F.split(text, "\n", -1)
    keep = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), dropped)
    kept = F.when(F.size(dropped) == 0, text).otherwise(
        F.get(F.transform(F.array(parts), lambda p: F.array_join(F.transform(keep, lambda i: F.get(p, i)), "\n")), 0)
    )
    return out.select(
        *[F.col(c) for c in docs.columns],
        F.size(parts).cast("bigint").alias("n_lines"),
        F.size(dropped).cast("bigint").alias("n_dropped"),
        kept.alias("kept_text"),
    )
