"""Write pages as WARC archives and read them back by verified boundary chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runsieve.llm.common import small_side, stored
from runsieve.session import fresh_dir

# Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Marks of segments that may be broadcast; beyond it the second scan keeps all texts.
MARKS = 100_000
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each 5 hex digits are 4 characters."""
    digest = F.upper(F.sha1(payload))

    def four(i: Column) -> Column:
        bits = F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(_BASE32), (F.shiftright(bits, n)).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for n in (15, 10, 5, 0)])

    return F.concat(*[four(F.lit(i)) for i in range(8)])


def roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(page_id, digest, refers_to)`` of the pages whose payload of at least ``min_bytes`` a page with a
    smaller id has too. Payloads are told apart by their SHA-256 and length."""
    html = F.coalesce("html", F.lit(""))
    light = pages.select("page_id", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("size"))
    light = stored(light.filter(F.col("size") >= min_bytes), "payloads")
    first = light.groupBy("digest", "size").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    later = light.join(first.filter("n > 1"), ["digest", "size"]).filter("page_id > refers_to")
    return later.select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """One record per row into the folder ``path``, files of consecutive records.

    A response's block is the html in UTF-8; a revisit has an empty block and names the response it
    repeats. Null html is an empty payload. Line breaks in a url are percent-encoded, a null url is left
    out. Of equal payloads the smallest id is the response; rows that repeat it, and null ids, are
    responses too. The text writer puts the record separator after each record, so archives are written
    on any file system that Spark reaches. Only ids and digests are shuffled unless the revisits are
    too many to broadcast.
    """
    later = stored(roles(pages, min_bytes), "revisits").select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "refers_to")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).join(
        small_side(later), (F.col("page_id") == F.col("_p")) & (F.sha2(F.col("html"), 256) == F.col("_d")), "left"
    )
    is_later = F.col("refers_to").isNotNull()
    block = F.when(is_later, F.lit("")).otherwise(F.col("html"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    header = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(is_later, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("html")))),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    rows.select(F.concat(header, block).alias("value")).write.option("lineSep", END).text(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The archives cut at each magic: ``file, part, nth, value`` with ``value`` the bytes after the magic.

    Archives are splittable; ``part`` is the start of the split and ``nth`` orders the segments in it.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("nth"),
        "value",
    )


def placed(rows: DataFrame) -> DataFrame:
    """Stored ``rows`` of one scan, with ``bytes`` of each segment, at their offsets ``at`` and ``end``.

    The offset is the bytes of all segments and magics before; they are added up inside a split, then over
    the splits of a file. ``part`` and ``nth`` hold for this scan only: another scan may cut and number
    the splits in another way, offsets stay the same.
    """
    in_split = Window.partitionBy("file", "part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    step = F.col("bytes") + len(MAGIC)
    splits = rows.groupBy("file", "part").agg(F.sum(step).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    rows = rows.withColumn("_in", F.coalesce(F.sum(step).over(in_split), F.lit(0))).join(splits, ["file", "part"])
    at = F.col("_base") + F.col("_in") - len(MAGIC)
    return rows.withColumn("at", at).withColumn("end", at + step).filter("at >= 0").drop("_base", "_in")


def texts_at(spark: SparkSession, path: str, pieces: DataFrame) -> DataFrame:
    """``file, at, value`` of the segments of ``pieces`` (``file, at, mark``) from one more scan.

    Offsets are those of this scan itself. The marks only tell which texts may be wanted, so that the
    others need not be stored; if there are too many marks to broadcast, all texts are.
    """
    marks = stored(pieces.select(F.col("mark").alias("_mark")).distinct(), "marks")
    n = marks.limit(MARKS + 1).count()
    if n == 0:
        return pieces.select("file", "at", F.lit("").alias("value"))
    seen = segments(spark, path).withColumn("bytes", F.octet_length("value").cast("bigint"))
    if n <= MARKS:
        seen = seen.join(F.broadcast(marks), F.xxhash64("value") == F.col("_mark"), "left")
        seen = seen.withColumn("value", F.when(F.col("_mark").isNotNull(), F.col("value"))).drop("_mark")
    seen = stored(seen, "texts")
    wanted = placed(seen.select("file", "part", "nth", "bytes")).join(pieces.select("file", "at"), ["file", "at"], "left_semi")
    return seen.join(wanted.select("file", "part", "nth", "at"), ["file", "part", "nth"]).select("file", "at", "value")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place with a magic: ``file, at, end, next`` with header fields, payload digest and ``mark``, a
    hash of the segment.

    ``at`` is the byte offset of the magic, ``end`` that of the next magic or the end of the file, and
    ``next`` that of the successor by the candidate's own header (null without a valid header). Payloads
    stay in the scan.
    """
    raw = segments(spark, path)
    head = F.locate(END, F.col("value"))
    header = F.when(head > 0, F.substring(F.col("value"), F.lit(1), head - 1))
    head_bytes = F.octet_length(header) + len(END)
    size = F.regexp_extract("header", r"(?i)(?:^|\n)Content-Length: *([0-9]{1,18})\r?(?:\n|$)", 1).try_cast("bigint")
    rows = raw.withColumn("header", header).withColumn("bytes", F.octet_length("value").cast("bigint")).withColumn("head", head_bytes).withColumn("size", size)
    # A header of any length counts; text before a blank line without a length is none and is not stored.
    rows = rows.withColumn("header", F.when(F.col("size").isNotNull(), F.col("header")))
    whole = F.col("head") + F.col("size") + len(END) == F.col("bytes")
    payload = F.substring(F.col("value").cast("binary"), F.col("head") + 1, F.col("size").cast("int"))
    rows = rows.select(
        "file", "part", "nth", "header", "bytes", "head", "size",
        F.when(whole, base32_sha1(payload)).alias("digest"), F.xxhash64("value").alias("mark"),
    )
    rows = placed(stored(rows, "candidates"))
    follow = F.col("at") + len(MAGIC) + F.col("head") + F.col("size") + len(END)
    return stored(rows.withColumn("next", follow).drop("part", "nth", "bytes"), "chain")


def reachable(chain: DataFrame) -> DataFrame:
    """``(file, at)`` of the candidates that the chain from the start of their file reaches.

    Pointer jumping: in each round every candidate's pointer becomes its pointer's pointer, and what a
    reached candidate points to is reached; the number of rounds is the logarithm of the records in the
    longest file. A successor counts only if a candidate stands there or the file ends there.
    """
    ptr = stored(chain.select("file", "at", F.col("next").alias("to"), (F.col("at") == 0).alias("hit")), "jump")
    before = None
    while (now := ptr.filter("hit").count()) != before:
        before = now
        far = ptr.select("file", F.col("at").alias("to"), F.col("to").alias("_to"))
        # Rows of what reached candidates point to; the aggregate below joins them with the candidate's own row.
        hits = ptr.filter("hit").select("file", F.col("to").alias("at"), F.lit(None).cast("bigint").alias("to"), F.lit(True).alias("hit"))
        moved = ptr.join(far, ["file", "to"], "left").select("file", "at", F.col("_to").alias("to"), "hit")
        both = moved.withColumn("own", F.lit(True)).unionAll(hits.filter("at IS NOT NULL").withColumn("own", F.lit(False)))
        ptr = both.groupBy("file", "at").agg(F.max("to").alias("to"), F.max("hit").alias("hit"), F.max("own").alias("own"))
        ptr = stored(ptr.filter("own").drop("own"), "jump")
    return ptr.filter("hit").select("file", "at")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives in ``path``: ``page_id, record_type, refers_to, url, payload_bytes,
    payload_digest`` (of the payload that was read; of the response's for a revisit).

    A magic inside a payload starts no record: it is not on the chain from the start of its file. A
    payload that holds one spans several segments; only such records are read a second time and put
    together by offset. Damaged tails end the chain of their file and are left out. No archives give no
    records.
    """
    chain = candidates(spark, path)
    reached = stored(reachable(chain), "reached")
    # A record counts if its end is the start of a reached record or the end of the file.
    ends = reached.unionAll(chain.groupBy("file").agg(F.max("end").alias("at"))).withColumnRenamed("at", "next")
    on_chain = stored(chain.join(reached, ["file", "at"]).join(ends, ["file", "next"], "left_semi"), "records")
    split_up = on_chain.filter("digest IS NULL AND next >= end").select("file", F.col("at").alias("from"), "next", "head", "size")
    owner = F.when(F.col("_r").isNotNull(), F.col("at"))
    line = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    marked = chain.join(split_up.select("file", F.col("from").alias("at"), F.lit(1).alias("_r")), ["file", "at"], "left")
    pieces = marked.select("file", "mark", "at", F.last(owner, ignorenulls=True).over(line).alias("from"))
    pieces = stored(pieces.join(split_up, ["file", "from"]).filter("at < next"), "pieces")
    joined = texts_at(spark, path, pieces).join(pieces, ["file", "at"]).groupBy("file", "from", "head", "size")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), MAGIC)
    joined = joined.agg(texts.alias("value"))
    payload = F.substring(F.col("value").cast("binary"), F.col("head") + 1, F.col("size").cast("int"))
    mended = joined.select("file", F.col("from").alias("at"), base32_sha1(payload).alias("_digest"))

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract("header", rf"(?:^|\n){name}: ([^\r\n]*)", 1), F.lit(""))

    def page(name: str) -> Column:
        return F.regexp_extract(F.coalesce(field(name), F.lit("")), "<urn:page:(-?[0-9]*)>", 1).try_cast("bigint")

    records = on_chain.join(mended, ["file", "at"], "left").select(
        page("WARC-Record-ID").alias("page_id"),
        field("WARC-Type").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
        field("WARC-Target-URI").alias("url"),
        F.col("size").alias("payload_bytes"),
        F.coalesce("digest", "_digest").alias("payload_digest"),
        F.regexp_extract(F.coalesce(field("WARC-Payload-Digest"), F.lit("")), "sha1:(.*)", 1).alias("_stated"),
    )
    records = stored(records, "read")
    first = records.filter("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("_stated"), F.col("payload_bytes").alias("_bytes")
    ).distinct()
    again = records.filter("record_type = 'revisit'").join(first, ["refers_to", "_stated"], "left")
    again = again.select("page_id", "record_type", "refers_to", "url", F.col("_bytes").alias("payload_bytes"), F.col("_stated").alias("payload_digest"))
    return records.filter("record_type <> 'revisit'").select(again.columns).unionAll(again)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the archives into a new folder of the shared one and read them back."""
    path = fresh_dir(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path)
