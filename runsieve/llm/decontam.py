"""Find benchmark passages in documents with a positional inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsieve.llm.common import ascii_lower, key_of, small_side, stored

# Fixed value: a word of the contract before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
#: A document is contaminated if at least one of this many words is hit.
HIT_SHARE = 20

_DOC = ["doc_id", "_t"]
#: Term number of the row that carries the number of words of a document.
_COUNT_TERM = -1


def words_of(text: Column) -> Column:
    """Words in order, not yet lower-cased."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def item_words(items: DataFrame) -> DataFrame:
    """``(item_id, pos, word, n_item)`` per word of the test items."""
    rows = items.select("item_id", key_of(F.col("text")).alias("_it"), words_of(F.col("text")).alias("w"))
    rows = rows.distinct().select("item_id", "_it", F.size("w").alias("n_item"), F.posexplode("w").alias("ipos", "word"))
    return rows.withColumn("word", ascii_lower(F.col("word")))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings ``(term, doc_id, _t, pos)`` of the terms in all documents, as a written table.

    ``terms`` has ``word`` and ``term``. Each document also has one row with term -1 whose position is
    its number of words.
    """
    end = F.array(F.lit(""))
    tokens = docs.select("doc_id", key_of(F.col("text")).alias("_t"), F.posexplode(F.concat(words_of(F.col("text")), end)).alias("pos", "word"))
    lookup = terms.unionAll(terms.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(_COUNT_TERM).cast("bigint").alias("term")))
    postings = tokens.withColumn("word", ascii_lower(F.col("word"))).join(small_side(stored(lookup, "terms")), "word")
    return stored(postings.select("term", "doc_id", "_t", "pos"), "postings")


def _anchors(words: DataFrame, df: DataFrame, window: int) -> DataFrame:
    """Per item the two rarest positions of each window: ``(item, a, a_term, b, b_term)``, distinct."""
    ranked = words.join(small_side(df), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    span = Window.partitionBy("item_id", "_it").orderBy("ipos").rowsBetween(0, window - 1)
    place = F.struct("df", "ipos", "term")
    seen = F.array_sort(F.collect_list(place).over(span))
    starts = ranked.select("item_id", "_it", "ipos", "n_item", seen.alias("s"))
    full = starts.filter(F.size("s") == F.least(F.lit(window), F.col("n_item")))
    rarest, second = F.get("s", F.lit(0)), F.coalesce(F.get("s", F.lit(1)), F.get("s", F.lit(0)))
    return full.select(
        "item_id", "_it", rarest["ipos"].alias("a"), rarest["term"].alias("a_term"), second["ipos"].alias("b"), second["term"].alias("b_term")
    ).distinct()


def _on(a: DataFrame, b: DataFrame, *also: Column) -> DataFrame:
    """Equi-join on the document (null-safe) and more columns; ``b`` has its document columns renamed."""
    b = b.withColumnsRenamed({"doc_id": "_d", "_t": "_dt"})
    cond = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_dt"))
    for c in also:
        cond = cond & c
    return a.join(b, cond).drop("_d", "_dt")


def find_phrases(postings: DataFrame, words: DataFrame, window: int = WINDOW) -> DataFrame:
    """Runs ``(doc_id, _t, item_id, start, end)`` of document words that occur in an item in the same order.

    A run has at least ``window`` words, or the whole item if it is shorter; ends are exclusive. From the
    rarest of each window's terms come the alignments of document and item (document position minus item
    position); those that the second rarest term confirms are intersected with the lists of all terms of
    the item, and consecutive positions on one alignment are the runs.
    """
    df = postings.filter(F.col("term") >= 0).groupBy("term").agg(F.count("*").alias("df"))
    anchors = stored(_anchors(words, stored(df, "df"), window), "anchors")
    item = ["item_id", "_it"]
    a = small_side(anchors.select(*item, "a", F.col("a_term").alias("term"), "b", "b_term").distinct())
    hits = postings.join(a, "term").select(*_DOC, *item, (F.col("pos") - F.col("a")).alias("diag"), "b", "b_term")
    hits = stored(hits.distinct(), "aligned")
    second = postings.join(small_side(anchors.select(F.col("b_term").alias("term")).distinct()), "term")
    second = second.select(*_DOC, F.col("pos").alias("_p"), F.col("term").alias("_term"))
    sure = _on(hits, second, F.col("b_term") == F.col("_term"), F.col("diag") + F.col("b") == F.col("_p"))
    sure = stored(sure.select(*_DOC, *item, "diag").distinct(), "confirmed")
    found = small_side(sure.select(*_DOC).distinct())
    lists = _on(postings.filter(F.col("term") >= 0), found)
    wanted = sure.join(
        small_side(words.select(*[F.col(c).alias(f"w_{c}") for c in item], "ipos", F.col("term").alias("i_term"), "n_item")),
        F.col("item_id").eqNullSafe(F.col("w_item_id")) & (F.col("_it") == F.col("w__it")),
    ).select(*_DOC, *item, "diag", "ipos", "n_item", "i_term", (F.col("diag") + F.col("ipos")).alias("i_pos"))
    on = _on(wanted, lists.select(*_DOC, "pos", "term").distinct(), F.col("i_term") == F.col("term"), F.col("i_pos") == F.col("pos"))
    line = Window.partitionBy(*_DOC, *item, "diag").orderBy("pos")
    runs = on.withColumn("_run", F.col("pos") - F.row_number().over(line)).groupBy(*_DOC, *item, "diag", "n_item", "_run")
    runs = runs.agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    return runs.filter(F.col("end") - F.col("start") >= F.least(F.lit(window), F.col("n_item"))).select(*_DOC, "item_id", "start", "end")


def find_near(postings: DataFrame, words: DataFrame, slack: int = 8, share: float = 0.8) -> DataFrame:
    """Proximity matches ``(doc_id, _t, item_id, n_terms)``: at least ``share`` of an item's positions match
    within ``slack`` words of one alignment, in any order of small shifts.

    Postings of an item's terms are gathered per alignment block of ``slack`` words; a block and the next
    one are taken together, so no match falls between two blocks.
    """
    item = ["item_id", "_it"]
    w = small_side(words.select(*item, "ipos", "term", "n_item"))
    diag = F.floor((F.col("pos") - F.col("ipos")) / slack)
    rows = postings.join(w, "term").select(*_DOC, *item, "n_item", "ipos", diag.alias("block"))
    rows = rows.select(*_DOC, *item, "n_item", "ipos", F.explode(F.array(F.col("block"), F.col("block") - 1)).alias("block"))
    counts = rows.distinct().groupBy(*_DOC, *item, "n_item", "block").agg(F.count("*").alias("n"))
    best = counts.groupBy(*_DOC, *item, "n_item").agg(F.max("n").alias("n_terms"))
    return best.filter(F.col("n_terms") >= F.ceil(F.col("n_item") * share)).select(*_DOC, "item_id", "n_terms")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = HIT_SHARE) -> DataFrame:
    """Per document ``doc_id, _t, n_words, n_hit, n_items, items_sha256, contaminated``.

    A word is hit if it lies in an occurrence of a window of consecutive item words; a document with
    hits in at least one of ``share`` words is contaminated. One row per distinct (id, text): ``_t`` is
    the hash of the text, so repeated rows give one row and an id with two texts gives two; null ids and
    null texts (no words) are documents too. Items without words have no window; rows that repeat an
    item count once. Empty tables give no hits.
    """
    words = item_words(items)
    terms = stored(words.select("word").distinct(), "vocabulary")
    # Numbers for the terms: a 64-bit hash, positive, so that -1 stays free.
    terms = terms.select("word", F.xxhash64("word").bitwiseAND(F.lit((1 << 62) - 1)).alias("term"))
    words = stored(words.withColumn("term", F.xxhash64("word").bitwiseAND(F.lit((1 << 62) - 1))).drop("word"), "items")
    postings = build_index(docs, terms)
    runs = stored(find_phrases(postings, words, window), "runs")
    place = Window.partitionBy(*_DOC).orderBy("start", "end")
    reach = F.max("end").over(place.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(reach, F.lit(0))))
    hits = runs.select("doc_id", "_t", "start", "end").distinct().withColumn("new", new).groupBy(*_DOC).agg(F.sum("new").alias("n_hit"))
    which = runs.select(*_DOC, F.col("item_id").cast("string").alias("item")).distinct().groupBy(*_DOC)
    which = which.agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    zero, text = F.lit(0).cast("bigint"), F.lit(None).cast("string")
    parts = postings.filter(F.col("term") == _COUNT_TERM).select(*_DOC, F.col("pos").cast("bigint").alias("n_words"), zero.alias("n_hit"), zero.alias("n_items"), text.alias("items"))
    parts = parts.unionAll(hits.select(*_DOC, zero, "n_hit", zero, text)).unionAll(which.select(*_DOC, zero, zero, "n_items", "items"))
    per_doc = parts.groupBy(*_DOC).agg(*[F.max(c).alias(c) for c in ("n_words", "n_hit", "n_items", "items")])
    return per_doc.select(
        *_DOC, "n_words", "n_hit", "n_items",
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = HIT_SHARE) -> DataFrame:
    """``docs`` without contaminated documents; columns, repeats, null ids and null texts stay.

    The ids to drop are few against the table: they are broadcast if they are at most a million.
    """
    bad = stored(contamination(docs, items, window, share).filter("contaminated").select(*_DOC), "contaminated")
    bad = small_side(bad.withColumnsRenamed({"doc_id": "_bad_id", "_t": "_bad_t"}))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad_id")) & (key_of(F.col("text")) == F.col("_bad_t")), "left_anti")
