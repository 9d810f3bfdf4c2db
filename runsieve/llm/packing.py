"""Pack token sequences of documents into training sequences by harmonic classes."""

from __future__ import annotations

import json
import os
import string
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runsieve.llm.common import BLANKS, ship, small_side, stored
from runsieve.llm.tokens import byte_class, encoded, runs, slices

ship(__name__)

CAPACITY = 2048
#: The id that ends every document.
END_ID = 1
#: Least share of a sequence that the equal pieces of a class must fill; a remainder that would fill less is cut.
FILL = 0.98
#: Bytes of text that are split and encoded together.
BLOCK_BYTES = 4 << 20
#: Distinct words whose ids a task remembers.
MEMO_WORDS = 300_000
#: Rows of an Arrow batch of pieces.
BATCH_PIECES = 2_000
_LINE_WORDS = 2_000

_BREAKS = byte_class(BLANKS)
_ALPHANUMERIC = byte_class(string.ascii_letters + string.digits)
_MARKS = byte_class(".,;:!?")
_PIECE = "doc_id {id}, start bigint, length bigint, ids binary, doc_tokens bigint, part int, size_class int, place bigint, before bigint"


def piece_lengths(tokens: int, capacity: int = CAPACITY, fill: float = FILL) -> list[int]:
    """Lengths into which a document of ``tokens`` ids is cut.

    Whole sequences come first. A remainder r belongs to the class k = capacity // r, of which k pieces
    share a sequence. If k of them fill less than ``fill`` of it, a piece of capacity // (k + 1) ids is cut
    off, which fills its class, and the far smaller rest is judged again.
    """
    lengths, rest = [capacity] * (tokens // capacity), tokens % capacity
    while rest:
        k = capacity // rest
        if k * rest >= fill * capacity:
            lengths.append(rest)
            break
        lengths.append(capacity // (k + 1))
        rest -= lengths[-1]
    return lengths


def parts_words(model: str) -> bool:
    """Whether a tokenizer lower-cases and takes runs of letters, single digits and runs of other characters
    apart, dropping white space: then words can be encoded one by one."""
    told = json.loads(model)
    normal = json.dumps(told.get("normalizer") or {})
    before = json.dumps(told.get("pre_tokenizer") or {})
    return "Lowercase" in normal and r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in before and '"Removed"' in before and not told.get("post_processor")


class WordIds:
    """Ids of whole texts.

    Where the tokenizer parts words (``parts_words``), a text is split at ASCII white space and before a
    punctuation mark that follows an ASCII letter or digit, two places that always part tokens; each distinct
    word is encoded once and remembered, up to ``MEMO_WORDS`` words. Other tokenizers get whole texts.
    """

    def __init__(self, model: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_str(model), parts_words(model)
        self.suffix = json.loads(model)["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab() if self.by_word and self.suffix else {}
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(self.suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.sizes, self.flat = np.empty(0, np.int64), np.empty(0, np.uint32)

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes, flat = [], []
        for lo in range(0, len(texts), 10_000):
            got = self.tokenizer.encode_batch_fast([t.decode() for t in texts[lo : lo + 10_000]], add_special_tokens=False)
            ids = [e.ids for e in got]
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), np.uint32))
        return np.concatenate(sizes), np.concatenate(flat)

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode() for w in words]
        # One run of lower-case Latin letters that no normalisation changes, so one word for the tokenizer as well.
        plain = np.fromiter((bool(self.suffix) and t.isalpha() and max(t) < "\u0180" and t == t.lower() for t in texts), bool, len(texts))
        sizes, parts = np.zeros(len(words), np.int64), []
        for lo in range(0, len(at := np.flatnonzero(plain)), _LINE_WORDS):
            some = at[lo : lo + _LINE_WORDS]
            line = self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in some])], add_special_tokens=False)[0]
            ids = np.array(line.ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                plain[some] = False
                continue
            sizes[some] = np.diff(ends, prepend=0)
            parts.append(ids)
        order = [np.flatnonzero(plain), np.flatnonzero(~plain)]
        if len(order[1]):
            sizes[order[1]], flat = self._encode([words[i] for i in order[1]])
            parts.append(flat)
        # Ids lie plain words first; put them back in the order of the words.
        order, flat = np.concatenate(order), np.concatenate(parts)
        n = sizes[order]
        firsts = np.empty(len(words), np.int64)
        firsts[order] = np.cumsum(n) - n
        return sizes, flat[np.repeat(firsts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))]

    def _look_up(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in words if w not in self.number]
        if len(self.number) + len(new) > MEMO_WORDS:
            self._forget()
            new = words
        if new:
            sizes, flat = self._encode_words(new)
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.sizes, self.flat = np.concatenate((self.sizes, sizes)), np.concatenate((self.flat, flat))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def block(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self.by_word:
            sizes, flat = self._encode(texts)
            return np.split(flat, np.cumsum(sizes)[:-1])
        # Special tokens are told by case, so a text that may hold one keeps its own.
        texts = [t if b"<|" in t else t.lower() for t in texts]
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        cut = np.zeros(len(raw), bool)
        cut[1:] = _MARKS[raw[1:]] & _ALPHANUMERIC[raw[:-1]]
        starts, ends, letters = runs(raw, _BREAKS, cut)
        if not len(starts):
            return [np.empty(0, np.uint32)] * len(texts)
        index, words = encoded(letters, ends - starts)
        number = self._look_up(words.to_pylist())[index]
        n = self.sizes[number]
        done = np.cumsum(n)
        firsts = np.cumsum(self.sizes) - self.sizes
        out = self.flat[np.repeat(firsts[number] - (done - n), n) + np.arange(done[-1])]
        limits = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
        return np.split(out, np.concatenate(([0], done))[limits[:-1]])

    def texts(self, texts: Iterator[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text in order; a null text has none."""
        block: list[bytes] = []
        size = 0
        for text in texts:
            data = (text or "").encode()
            if len(data) > BLOCK_BYTES:
                yield from self.block(block) if block else []
                parts = slices(data, _BREAKS, BLOCK_BYTES) if self.by_word else [data]
                yield np.concatenate([self.block([s])[0] for s in parts])
                block, size = [], 0
                continue
            block.append(data)
            size += len(data) + 1
            if size >= BLOCK_BYTES:
                yield from self.block(block)
                block, size = [], 0
        if block:
            yield from self.block(block)


def _cut(model, id_type: pa.DataType, capacity: int, end_id: int, fill: float):
    """Pieces of the documents of a task; the task fills the sequences of each class by itself: ``place``
    counts its pieces of the class, ``before`` the ids already in the sequence."""
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "part", "size_class", "place", "before"]
    types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(names, types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = WordIds(model.value), TaskContext.get().partitionId()
        count, used = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
        rows: list[list] = [[] for _ in names]
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for doc, ids in zip(docs, words.texts(t.as_py() for t in batch.column(1))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                start = 0
                for length in piece_lengths(len(ids), capacity, fill):
                    k = capacity // length
                    place = int(count[k])
                    if place % k == 0:
                        used[k] = 0
                    row = (doc, start, length, ids[start : start + length].tobytes(), len(ids), part, k, place, int(used[k]))
                    for column, value in zip(rows, row):
                        column.append(value)
                    count[k] += 1
                    used[k] += length
                    start += length
                if len(rows[0]) >= BATCH_PIECES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], schema=schema)
                    rows = [[] for _ in names]
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], schema=schema)

    return run


def _first_fit(capacity: int):
    """Put each piece, longest first, into the first sequence with room for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        table = table.sort_by([("length", "descending"), ("size_class", "ascending"), ("rank", "ascending")])
        room: list[int] = []
        bins, before = [], []
        for length in table.column("length").to_pylist():
            at = next((i for i, r in enumerate(room) if r >= length), len(room))
            if at == len(room):
                room.append(capacity)
            bins.append(at)
            before.append(capacity - room[at])
            room[at] -= length
        out = table.select(["size_class", "rank"]).append_column("bin", pa.array(bins, pa.int64())).append_column("at", pa.array(before, pa.int64()))
        yield from out.to_batches()

    return run


def pack(docs: DataFrame, model: str, capacity: int = CAPACITY, end_id: int = END_ID, fill: float = FILL) -> DataFrame:
    """Per piece ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``: ids ``start`` to
    ``start + length`` of the document (unsigned 32-bit little-endian in ``ids``) lie at ``offset`` of the
    sequence. A document's ids are those of its text by the tokenizer file ``model`` without special tokens,
    then ``end_id``; each id lies in exactly one piece, no sequence exceeds ``capacity``.

    Every task cuts its documents (``piece_lengths``) and fills the sequences of each class with its fixed
    number of pieces. The pieces of a task's last, unfilled sequence of a class meet those of the other
    tasks, again a fixed number to a sequence. What is left then, fewer than k pieces of each class k (some
    ten thousand rows at most, whatever the input), is placed first-fit by decreasing length.
    Sequences are numbered without gaps from counts per task and class. Pieces with full texts move only
    if their sequence is shared between tasks.

    Null and empty texts are one id long. Rows that repeat an id, null ids included, are separate documents.
    Extra columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    with open(model, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())
    kind = docs.schema["doc_id"].dataType
    arrow = pa.int64() if kind.typeName() in ("long", "integer", "short", "byte") else pa.string()
    doc_id = F.col("doc_id").cast("bigint" if arrow == pa.int64() else "string")
    cut = docs.select(doc_id.alias("doc_id"), "text").mapInArrow(
        _cut(shared, arrow, capacity, end_id, fill), _PIECE.format(id="bigint" if arrow == pa.int64() else "string")
    )
    pieces = stored(cut, "pieces")
    k = F.col("size_class")
    counts = pieces.groupBy("part", "size_class").agg(F.count("*").alias("n"))
    counts = counts.select("part", "size_class", F.floor(F.col("n") / k).alias("whole"), (F.col("n") % k).alias("loose"))
    in_class = Window.partitionBy("size_class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(
        counts.select(
            "*", *[F.coalesce(F.sum(c).over(in_class), F.lit(0)).alias(f"{c}_before") for c in ("whole", "loose")]
        ),
        "counts",
    )
    # One row per class, of which there are some two square roots of the capacity.
    totals = counts.groupBy("size_class").agg(F.sum("whole").alias("whole"), F.sum("loose").alias("loose")).collect()
    first, shared_first, at = {}, {}, 0
    for row in sorted(totals):
        first[row["size_class"]], at = at, at + row["whole"]
    loose = {row["size_class"]: row["loose"] for row in totals}
    for size_class, n in sorted(loose.items()):
        shared_first[size_class], at = at, at + n // size_class

    def by_class(values: dict[int, int]):
        pairs = [F.lit(x) for pair in sorted(values.items()) for x in pair]
        return F.create_map(*pairs)[k] if pairs else F.lit(None).cast("bigint")

    bounds = counts.select(F.col("part").alias("_part"), F.col("size_class").alias("_class"), "whole", "whole_before", "loose_before")
    placed = pieces.join(small_side(bounds), (F.col("part") == F.col("_part")) & (k == F.col("_class"))).drop("_part", "_class")
    home = F.floor(F.col("place") / k)
    columns = ["doc_id", "start", "length", "ids", "doc_tokens"]
    own = placed.filter(home < F.col("whole")).select(
        *columns, (by_class(first) + F.col("whole_before") + home).cast("bigint").alias("sequence_id"), F.col("before").alias("offset")
    )
    rest = placed.filter(home >= F.col("whole")).select(
        *columns, "size_class", (F.col("loose_before") + F.col("place") - F.col("whole") * k).alias("rank")
    )
    rest = stored(rest, "loose")
    group = F.floor(F.col("rank") / k)
    left = {c: n - n % c for c, n in loose.items()}
    in_sequence = Window.partitionBy("size_class", "_group").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    met = rest.filter(F.col("rank") < by_class(left)).withColumn("_group", group)
    met = met.select(
        *columns,
        (by_class(shared_first) + F.col("_group")).cast("bigint").alias("sequence_id"),
        F.coalesce(F.sum("length").over(in_sequence), F.lit(0)).alias("offset"),
    )
    last = rest.filter(F.col("rank") >= by_class(left))
    fitted = last.select("size_class", "rank", "length").repartition(1).mapInArrow(_first_fit(capacity), "size_class int, rank bigint, bin bigint, at bigint")
    last = last.join(F.broadcast(fitted), ["size_class", "rank"]).select(
        *columns, (F.lit(at) + F.col("bin")).cast("bigint").alias("sequence_id"), F.col("at").alias("offset")
    )
    return own.unionAll(met).unionAll(last)


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, tokens, ids``: the sequences themselves, pieces joined in order of their offset. A
    sequence holds no more than its capacity of pieces, so no group grows."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), joined.alias("ids"))
