"""Mine phrase collocations from counts of padded longest windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsieve.llm.common import ship, small_side, stored
from runsieve.llm.shingles import scramble
from runsieve.llm.tokens import byte_class, encoded, hashes, runs, slices

ship(__name__)

MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2000
#: A candidate falls if a longer one around it has this share of its occurrences, in per cent.
SUBSUMED_PERCENT = 100
#: Words and pairs, then runs of 3 to MAX_WORDS words, are counted in 2**TABLE_BITS cells; one bit per cell is
#: broadcast (16 MB for each of the two tables).
TABLE_BITS = 27
_CHUNK_BITS = 16
#: Text bytes of one language that a task counts together.
BLOCK_BYTES = 8 << 20
#: Rows of counted windows that a task holds at most to merge those of its blocks (some 200 MB).
MERGE_ROWS = 1 << 22
#: Salt buckets of a language's ranking.
RANK_BUCKETS = 64

_ENDS, _BLANKS = byte_class(".,;:!?\n\x0b\x0c\r"), byte_class(" \t")
_BREAKS = _ENDS | _BLANKS
_WORDS = [f"w{i + 1}" for i in range(MAX_WORDS)]
_WINDOW = pa.schema([("lang", pa.string()), *[(w, pa.string()) for w in _WORDS], ("n", pa.int64())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Texts of one language in blocks that end where a piece ends, with A-Z lower-cased."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = (text.as_py() or "").encode().lower()
            for part in slices(data, _ENDS, BLOCK_BYTES):
                held.setdefault(lang, []).append(part)
                size += len(part) + 1
                if size >= BLOCK_BYTES:
                    for key in list(held):
                        yield key, b"\n".join(held.pop(key))
                    size = 0
    for key in list(held):
        yield key, b"\n".join(held.pop(key))


def _tokens(block: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of a block as numbers, whether the next word follows in the same piece, and the distinct words."""
    raw = np.frombuffer(block, np.uint8)
    starts, ends, letters = runs(raw, _BREAKS)
    index, words = encoded(letters, ends - starts)
    piece = np.cumsum(_ENDS[raw], dtype=np.int64)[starts]
    follows = np.zeros(len(starts), bool)
    follows[:-1] = piece[1:] == piece[:-1]
    return index, follows, words


def _word_cells(lang: str, words: pa.Array) -> np.ndarray:
    """A number per distinct word of a language; its high bits name the cell."""
    salt = hashes(pa.array([b"l" + lang.encode()], pa.large_binary()))[0]
    return scramble(hashes(words) + scramble(np.array([salt]))[0])


def _cell(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _extend(run: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The number of a run with one more word."""
    return scramble(run * np.uint64(3) + word)


def _chunked(cells: np.ndarray) -> pa.RecordBatch:
    """Cells as sorted 16-bit numbers per chunk of the table."""
    cells = np.sort(cells.astype(np.uint32))
    present, firsts = np.unique((cells >> _CHUNK_BITS).astype(np.int32), return_index=True)
    parts = np.split((cells & ((1 << _CHUNK_BITS) - 1)).astype("<u2"), firsts[1:]) if len(cells) else []
    return pa.RecordBatch.from_arrays([pa.array(present, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "cells"])


def _count_short(least: int):
    """Cells of words and of neighbouring pairs. A word's cell repeats up to ``least`` times a block, which is
    all that a threshold needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, block in _blocks(batches):
            index, follows, words = _tokens(block)
            if not len(index):
                continue
            mixed = _word_cells(lang, words)
            times = np.minimum(np.bincount(index, minlength=len(words)), least)
            pairs = np.flatnonzero(follows)
            yield _chunked(np.concatenate((np.repeat(_cell(mixed), times), _cell(_extend(mixed[index[pairs]], mixed[index[pairs + 1]])))))

    return run


def _count_longer(short):
    """Cells of the runs of 3 to MAX_WORDS words whose words and pairs may all be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(short.value, np.uint8)
        for lang, block in _blocks(batches):
            index, follows, words = _tokens(block)
            if not len(index):
                continue
            mixed = _word_cells(lang, words)
            joined = _joined(index, follows, mixed, table)
            at, cells = np.flatnonzero(joined), []
            number = _extend(mixed[index[at]], mixed[index[at + 1]])
            for size in range(3, MAX_WORDS + 1):
                more = joined[at + size - 2]
                at = at[more]
                number = _extend(number[more], mixed[index[at + size - 1]])
                cells.append(_cell(number))
            yield _chunked(np.concatenate(cells))

    return run


def _threshold(least: int):
    """Add up the chunks of a partition; a bit per cell tells whether it reaches ``least``."""
    schema = pa.schema([("chunk", pa.int32()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = counts.setdefault(chunk, np.zeros(1 << _CHUNK_BITS, np.uint64))
                got += np.bincount(np.frombuffer(cells.as_buffer(), "<u2"), minlength=1 << _CHUNK_BITS).astype(np.uint64)
        for chunk, got in counts.items():
            bits = np.packbits(got >= least, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([bits], pa.binary())], schema=schema)

    return run


def _frequent_cells(texts: DataFrame, count, least: int):
    """A broadcast bit table of a size fixed by ``TABLE_BITS``: whatever ``count`` counts and occurs ``least``
    times lies in a marked cell, so what has an unmarked one is surely rarer."""
    cells = texts.mapInArrow(count, "chunk int, cells binary").repartition(64, "chunk")
    table = np.zeros((1 << (TABLE_BITS - _CHUNK_BITS), 1 << (_CHUNK_BITS - 3)), np.uint8)
    rows = cells.mapInArrow(_threshold(least), "chunk int, bits binary").toArrow()
    for chunk, bits in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
        table[chunk] = np.frombuffer(bits, np.uint8)
    return texts.sparkSession.sparkContext.broadcast(table.tobytes())


def _marked(table: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return ((table[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1).astype(bool)


def _joined(index: np.ndarray, follows: np.ndarray, mixed: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each word and the next form a pair of one piece that may be frequent; padded at the end."""
    alone = _marked(table, _cell(mixed))[index]
    pairs = np.flatnonzero(follows & alone & np.append(alone[1:], False))
    joined = np.zeros(len(index) + MAX_WORDS, bool)
    joined[pairs[_marked(table, _cell(_extend(mixed[index[pairs]], mixed[index[pairs + 1]])))]] = True
    return joined


def _block_windows(lang: str, block: bytes, table: np.ndarray, long_table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The longest window at every word of a block, counted: the word and those that follow in its piece,
    padded with null from the word on that makes a run too rare for any candidate."""
    index, follows, words = _tokens(block)
    if not len(index):
        return
    mixed = _word_cells(lang, words)
    joined = _joined(index, follows, mixed, table)
    text = words.cast(pa.large_string()).cast(pa.string())
    at = np.flatnonzero(_marked(table, _cell(mixed))[index])
    # Distinct windows of one length as numbers; the next length extends them, so equal windows meet exactly.
    level, number, run_of = [np.arange(len(words))], index[at].astype(np.int64), mixed[index[at]]
    rows: list[tuple[list[np.ndarray], np.ndarray]] = [([], np.array([len(index) - len(at)]))]
    for size in range(1, MAX_WORDS + 1):
        more = joined[at + size - 1] if size < MAX_WORDS else np.zeros(len(at), bool)
        run_of = _extend(run_of[more], mixed[index[at[more] + size]]) if size < MAX_WORDS else run_of
        if 2 <= size < MAX_WORDS:
            frequent = _marked(long_table, _cell(run_of))
            more[more], run_of = frequent, run_of[frequent]
        ends_here = np.bincount(number[~more], minlength=len(level[0]))
        kept = np.flatnonzero(ends_here)
        rows.append(([w[kept] for w in level], ends_here[kept]))
        at, number = at[more], number[more]
        if not len(at):
            break
        key, number = np.unique((number << 32) | index[at + size], return_inverse=True)
        level = [w[key >> 32] for w in level] + [key & 0xFFFFFFFF]
    for columns, n in rows:
        if not n.any():
            continue
        taken = [text.take(pa.array(c)) for c in columns] + [pa.nulls(len(n), pa.string())] * (MAX_WORDS - len(columns))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), *taken, pa.array(n, pa.int64())], schema=_WINDOW)


def _merged(held: list[pa.RecordBatch]) -> pa.Table:
    """Equal windows as one row with the sum of their counts."""
    sums = pa.Table.from_batches(held).group_by(_WINDOW.names[:-1], use_threads=False).aggregate([("n", "sum")])
    return sums.select([*_WINDOW.names[:-1], "n_sum"]).rename_columns(_WINDOW.names)


def _windows(short, longer):
    """The counted windows of a task's blocks. Blocks share most windows, so a task merges what it holds whenever
    that has doubled; what then still fills three quarters of ``MERGE_ROWS`` goes out, and the task begins anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, long_table = np.frombuffer(short.value, np.uint8), np.frombuffer(longer.value, np.uint8)
        held: list[pa.RecordBatch] = []
        due = MERGE_ROWS // 8
        for lang, block in _blocks(batches):
            held.extend(_block_windows(lang, block, table, long_table))
            if sum(b.num_rows for b in held) >= due:
                merged = _merged(held)
                held = merged.to_batches()
                if merged.num_rows >= MERGE_ROWS * 3 // 4:
                    yield from merged.to_batches(max_chunksize=1 << 16)
                    held = []
                due = min(max(2 * sum(b.num_rows for b in held), MERGE_ROWS // 8), MERGE_ROWS)
        if held:
            yield from _merged(held).to_batches(max_chunksize=1 << 16)

    return run


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``(lang, size, phrase, f)``: exact occurrences of every phrase of up to ``MAX_WORDS`` words that occurs
    ``min_count`` times or more in its language; size 0 is the number of all words.

    Only longest windows are counted. ROLLUP over their lead columns adds up ever shorter prefixes, and a
    prefix of k columns without padding is a phrase of k words, so no shorter window is ever made.

    Nearly every task meets nearly every frequent window, and both tasks and frequent windows grow with the
    input. So windows are counted in one task a core, whatever the number of splits: a larger input
    makes longer tasks, and the rows they give grow with the windows alone.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    short = _frequent_cells(texts, _count_short(min_count), min_count)
    longer = _frequent_cells(texts, _count_longer(short), min_count)
    kinds = ", ".join(["lang string", *[f"{w} string" for w in _WORDS], "n bigint"])
    few = texts.coalesce(texts.sparkSession.sparkContext.defaultParallelism)
    windows = few.mapInArrow(_windows(short, longer), kinds).groupBy("lang", *_WORDS).agg(F.sum("n").alias("n"))
    windows = stored(windows, "windows")
    rolled = windows.rollup("lang", *_WORDS).agg(F.sum("n").alias("f"), F.grouping_id().alias("gid"))
    # The columns that a prefix of k words leaves out are the last ones: gid = 2**(MAX_WORDS - k) - 1.
    size = F.coalesce(*[F.when(F.col("gid") == 2 ** (MAX_WORDS - k) - 1, k) for k in range(MAX_WORDS + 1)])
    padded = F.array_size(F.array_compact(F.array(*_WORDS))) != F.col("size")
    phrases = rolled.withColumn("size", size).filter(F.col("size").isNotNull() & ~padded)
    return phrases.filter((F.col("size") == 0) | (F.col("f") >= min_count)).select("lang", "size", F.array_join(F.array(*_WORDS), " ").alias("phrase"), "f")


def _part(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, subsumed_percent: int = SUBSUMED_PERCENT) -> DataFrame:
    """Per language the ``top`` phrases of 2 to ``MAX_WORDS`` words: ``lang, rank, phrase, a, l, r, n, score``.

    Words are runs without blanks inside pieces that punctuation and line ends part, A-Z lower-cased.
    ``a`` counts the phrase, ``n`` all words of the language; the cut with the lowest floor(1000 a n / (l r))
    counts, ties to the shorter first part. A phrase inside a longer candidate that has
    ``subsumed_percent`` of its occurrences is dropped. Order: score and a descending, then phrase in
    byte order.

    A null language is ``und``; null and empty texts have no words. Repeated rows count each time; other
    columns are ignored. Texts are counted whole, in blocks that end where a piece ends. Products are exact
    decimals. An empty table gives an empty result.
    """
    counts = stored(phrase_counts(docs, min_count), "phrases")
    totals = small_side(stored(counts.filter("size = 0").select("lang", F.col("f").alias("n")), "totals"))
    known = counts.filter("size > 0").select("lang", "phrase", "f")
    candidates = counts.filter("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", F.split("phrase", " ").alias("w"))
    cuts = candidates.select("lang", "phrase", "a", "size", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _part(F.col("w"), F.lit(1), F.col("k")).alias("head"), _part(F.col("w"), F.col("k") + 1, F.col("size") - F.col("k")).alias("tail")
    )
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    cuts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")
    big = "cast({} as decimal(17,0))".format
    score = F.expr(f"(cast(1000 as decimal(4,0)) * {big('a')} * {big('n')}) div ({big('l')} * {big('r')})")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("b"))
    inside = candidates.filter("size > 2").select(
        "lang", F.col("a").alias("f"), "size", "w", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k")
    )
    inside = inside.select("lang", "f", "w", "k", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)).alias("i"))
    around = inside.groupBy("lang", _part(F.col("w"), F.col("i"), F.col("k")).alias("phrase")).agg(F.max("f").alias("longer"))
    kept = best.join(around, ["lang", "phrase"], "left").filter(
        F.coalesce(F.col("longer") * 100 < F.col("b.a") * subsumed_percent, F.lit(True))
    )
    kept = kept.select("lang", "phrase", *[F.col(f"b.{c}").alias(c) for c in ("a", "l", "r", "n", "score")])
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's best are the best of its buckets' best, so no language gathers whole in one task.
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(RANK_BUCKETS))
    first = kept.withColumn("_b", bucket).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_b").orderBy(*order))).filter(F.col("_r") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    return first.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
