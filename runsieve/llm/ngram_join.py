"""Exact Jaccard self-join of word-shingle sets over token-combination prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsieve.llm.common import key_of, ship, small_side, stored
from runsieve.llm.components import connected
from runsieve.llm.shingles import digest, parity, scramble, shingle_sets

ship(__name__)

#: Tokens are counted in 2**TABLE_BITS cells; two bits per cell are broadcast (32 MB).
TABLE_BITS = 27
_CHUNK_BITS = 16
#: Cells with more than this many times the mean load are frequent.
FREQUENT = 32
#: Tokens of one task that are counted together.
FLUSH_TOKENS = 2_000_000
#: Sets above this size index frequent tokens alone instead of in pairs, which would be quadratic in the prefix.
PAIRED_SIZE = 1024
#: 64-bit words of the parity bitmap.
PARITY_WORDS = 8
_RARE, _FREQUENT = 2, 3
#: Bins of which each open document notes its least key.
MEETING_BINS = 16


def min_overlap(n: int, percent: int) -> int:
    """The least overlap of a set of ``n`` with any set of Jaccard ``percent``."""
    return -(-n * percent // 100)


def _each(texts: pa.Array) -> Iterator[str | None]:
    """Texts one by one, so that a batch is not held twice."""
    return (t.as_py() for t in texts)


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, bits = [], [], [], []
            for items in shingle_sets(_each(batch.column(1)), k):
                n.append(len(items))
                x, y = digest(items)
                a.append(x)
                b.append(y)
                bits.append(parity(items, PARITY_WORDS).tolist())
            columns = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t", "n", "h", "g", "bits"])

    return run


def _count_cells(k: int):
    """Cells of all tokens of a task, as sorted 16-bit numbers per chunk of the table."""
    schema = pa.schema([("chunk", pa.int32()), ("cells", pa.binary())])

    def packed(cells: list[np.ndarray]) -> pa.RecordBatch:
        all_cells = np.sort(np.concatenate(cells))
        chunks = (all_cells >> _CHUNK_BITS).astype(np.int32)
        low = (all_cells & ((1 << _CHUNK_BITS) - 1)).astype("<u2")
        present, firsts = np.unique(chunks, return_index=True)
        parts = [p.tobytes() for p in np.split(low, firsts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(present, pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, held = [], 0
        for batch in batches:
            for items in shingle_sets(_each(batch.column(0)), k):
                cells.append((items >> np.uint64(64 - TABLE_BITS)).astype(np.uint32))
                held += len(items)
                if held >= FLUSH_TOKENS:
                    yield packed(cells)
                    cells, held = [], 0
        if held:
            yield packed(cells)

    return run


def _classify(mean: float):
    """Add up the chunks of a partition and keep two bits a cell: 0 none or one token, so surely unique;
    1 up to twice the mean and a few; 2 more; 3 frequent."""
    schema = pa.schema([("chunk", pa.int32()), ("classes", pa.binary())])
    edges = np.array([2, 4 + 2 * mean, FREQUENT * (1 + mean)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = counts.setdefault(chunk, np.zeros(1 << _CHUNK_BITS, np.uint32))
                got += np.bincount(np.frombuffer(cells, "<u2"), minlength=1 << _CHUNK_BITS).astype(np.uint32)
        for chunk, got in counts.items():
            kind = np.searchsorted(edges, got, side="right").astype(np.uint8).reshape(-1, 4)
            flat = (kind << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([flat.tobytes()], pa.binary())], schema=schema)

    return run


def token_classes(docs: DataFrame, k: int, tokens: int):
    """A broadcast table with the frequency class of every cell, counted over all documents.

    Its size is fixed by ``TABLE_BITS``. The class is a function of the token, so any counts, also those
    of cells that tokens share, give a valid order.
    """
    spark = docs.sparkSession
    mean = tokens / (1 << TABLE_BITS)
    cells = docs.select("text").mapInArrow(_count_cells(k), "chunk int, cells binary").repartition(64, "chunk")
    table = np.zeros((1 << (TABLE_BITS - _CHUNK_BITS), 1 << (_CHUNK_BITS - 2)), np.uint8)
    rows = cells.mapInArrow(_classify(mean), "chunk int, classes binary").toArrow()
    for chunk, flat in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
        table[chunk] = np.frombuffer(flat, np.uint8)
    return spark.sparkContext.broadcast(table.tobytes())


def _pairs(tokens: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(len(tokens), 1)
    return scramble(tokens[i] * np.uint64(3) + scramble(tokens[j]))


def _prefix_keys(items: np.ndarray, table: np.ndarray, percent: int) -> np.ndarray:
    """Index keys of a set.

    Tokens are ordered from rare to frequent. If two sets overlap enough, their first two common tokens
    lie in the prefixes of both that are two longer than the tokens that may be missing: so they share a
    rare token of the prefix, or else a pair of frequent ones. A token that is alone in its cell occurs
    nowhere else and needs no key. Sets above PAIRED_SIZE index frequent tokens singly, and sets that
    can be similar to one of those do both.
    """
    n = len(items)
    if n < 2:
        return items[:0]
    cell = (items >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    kind = (table[cell >> 2] >> ((cell & 3) << 1).astype(np.uint8)) & 3
    order = np.argsort(kind, kind="stable")[: n - min_overlap(n, percent) + 2]
    first, kind = items[order], kind[order]
    often = first[kind == _FREQUENT]
    keys = [first[(kind > 0) & (kind <= _RARE)]]
    if n <= PAIRED_SIZE:
        keys.append(_pairs(often))
    if n * 100 > PAIRED_SIZE * percent:
        keys.append(often)
    return np.concatenate(keys)


def _index(k: int, percent: int, classes):
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(classes.value, np.uint8)
        for batch in batches:
            ids, hashes, keys = [], [], []
            for doc, t, items in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(_each(batch.column(1)), k)):
                got = _prefix_keys(items, table, percent)
                if doc is not None and len(got):
                    ids.append(doc)
                    hashes.append(t)
                    keys.append(got.view(np.int64))
            columns = [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _sets(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("items", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                items = [x.tobytes() for x in shingle_sets(_each(part.column(1)), k)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(items, pa.binary())], schema=schema)

    return run


def _verify(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int(np.count_nonzero(y[at] == x))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], schema=schema)

    return run


def _may_link(percent: int) -> Column:
    """Bounds on two sets ``x`` and ``y``: by their sizes and by their parity bitmaps."""
    nx, ny = F.col("x.n"), F.col("y.n")
    bits = sum((F.bit_count(F.get("x.bits", F.lit(i)).bitwiseXOR(F.get("y.bits", F.lit(i)))) for i in range(PARITY_WORDS)), F.lit(0))
    return (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent) & (bits * (100 + percent) <= (nx + ny) * (100 - percent))


def _meeting(inside: DataFrame) -> DataFrame:
    """Per document its least key in each bin of keys."""
    key_bin = F.pmod(F.xxhash64("key"), F.lit(MEETING_BINS))
    least = [F.min(F.when(key_bin == b, F.col("key"))).alias(f"k{b}") for b in range(MEETING_BINS)]
    return inside.groupBy("doc_id").agg(*least)


def _meets_here() -> Column:
    """Whether ``x`` and ``y`` shall meet at this key: the least keys of some bins are often equal, which makes
    the first such key their one meeting place; a pair without one meets at every shared key."""
    same = [F.when(F.col(f"x.k{b}") == F.col(f"y.k{b}"), F.col(f"x.k{b}")) for b in range(MEETING_BINS)]
    return F.coalesce(F.coalesce(*same) == F.col("x.key"), F.lit(True))


def similar_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row ``doc_id, n_shingles, component_id``: groups of documents that links of Jaccard similarity
    ``percent`` or more join, over distinct shingles of ``k`` words.

    Equal sets are one class, so copies cost one row. Each class representative is indexed by
    its prefix keys. Keys that two representatives share give links to the first representative of
    the key; a verified star makes a group of near copies one component in linear work. What stars leave
    open, pairs of one key in different components, is joined on the key under the size and bitmap bounds
    and verified too, each pair at one of its shared keys as a rule (``_meets_here``); a pair inside one
    component cannot change the result and is never made. Verification intersects whole sets.

    A text of fewer than ``k`` words is one shingle; without words it has none, is linked with nothing and
    is its own component. A null id takes no part and has a null component. Rows that repeat an id are
    judged by their own text. Extra columns are ignored. An empty table gives an empty result.
    """
    out = _grouped(docs, k, percent)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per row its id, hash of its text, size and digest of its set, and component."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50, so that similar sets of two tokens share both")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", key_of(F.col("text")).alias("t"))
    described = docs.mapInArrow(_describe(k), "doc_id bigint, t bigint, n bigint, h bigint, g bigint, bits array<bigint>")
    about = stored(described, "about")
    real = about.filter("doc_id IS NOT NULL AND n > 0")
    reps = real.groupBy("h", "g").agg(F.min(F.struct("doc_id", "t")).alias("r")).select("h", "g", F.col("r.doc_id").alias("rep"), F.col("r.t").alias("rep_t"))
    reps = stored(reps, "classes")
    # A class goes by the id of its representative, or by a hash if that id stands for several texts.
    twice = small_side(stored(reps.groupBy("rep").agg(F.count("*").alias("m")).filter("m > 1").select("rep", F.lit(True).alias("twice")), "twice"))
    reps = reps.join(twice, "rep", "left").withColumn("node", F.when(F.col("twice"), F.xxhash64("rep", "rep_t")).otherwise(F.col("rep"))).drop("twice")
    reps = stored(reps, "nodes")
    node_of = reps.select(F.col("rep").alias("doc_id"), F.col("rep_t").alias("t"), "node")

    def by_node(rows: DataFrame, *columns: str) -> DataFrame:
        """Rows of representatives, with the node in the place of the id."""
        return rows.join(node_of, ["doc_id", "t"]).select(F.col("node").alias("doc_id"), *columns)

    tokens = about.agg(F.sum("n")).first()[0] or 0
    classes = token_classes(docs, k, tokens)
    keys = docs.mapInArrow(_index(k, percent, classes), "doc_id bigint, t bigint, keys array<bigint>")
    keys = stored(by_node(keys, "keys"), "keys")
    postings = keys.select("doc_id", F.explode("keys").alias("key"))
    shared = postings.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("m"))
    shared = stored(shared.filter("last > first"), "shared")
    # A key of two representatives is settled by its star; only longer lists are kept.
    lists = stored(postings.join(shared.filter("m > 2").select("key", "first"), "key"), "lists")
    sketch = by_node(real.select("doc_id", "t", "n", "bits").distinct(), "n", "bits")
    ends = shared.filter("m = 2").select(F.col("first").alias("a"), F.col("last").alias("b"))
    stars = ends.unionAll(lists.filter("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))).distinct()
    x, y = sketch.alias("x"), sketch.alias("y")
    stars = stars.join(x, F.col("a") == F.col("x.doc_id")).join(y, F.col("b") == F.col("y.doc_id")).filter(_may_link(percent)).select("a", "b")
    stars = stored(stars, "stars")
    listed = lists.select("doc_id").unionAll(lists.select("first")).unionAll(stars.select("a")).unionAll(stars.select("b")).distinct()
    listed = listed.join(node_of.withColumnRenamed("doc_id", "_id").withColumnRenamed("t", "_t"), F.col("doc_id") == F.col("node"))
    listed = small_side(stored(listed.select("_id", "_t"), "listed"))
    texts = docs.join(listed, (F.col("doc_id") == F.col("_id")) & (F.col("t") == F.col("_t")), "left_semi")
    sets = stored(by_node(texts.mapInArrow(_sets(k), "doc_id bigint, t bigint, items binary").dropDuplicates(["doc_id", "t"]), "items"), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        left, right = (sets.select(F.col("doc_id").alias(c), F.col("items").alias(f"{c}_items")) for c in "ab")
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "a_items", "b_items")
        return stored(both.mapInArrow(_verify(percent), "a bigint, b bigint"), "links")

    links = verified(stars)
    groups = stored(connected(links), "groups")
    node = groups.select(F.col("id").alias("doc_id"), "component_id")
    head = groups.select(F.col("id").alias("first"), F.col("component_id").alias("head"))
    state = lists.join(node, "doc_id", "left").join(head, "first", "left").select(
        "key", "doc_id", "first", F.coalesce("component_id", "doc_id").alias("c"), F.coalesce("head", "first").alias("head")
    )
    state = stored(state, "state")
    outside = state.filter("c <> head")
    open_keys = outside.select("key").distinct()
    inside = state.join(open_keys, "key", "left_semi").join(sketch, "doc_id")
    inside = stored(inside.join(_meeting(inside), "doc_id"), "open")
    pairs = inside.filter("c <> head").alias("x").join(inside.alias("y"), F.col("x.key") == F.col("y.key"))
    new = (F.col("x.c") != F.col("y.c")) & (F.col("y.doc_id") != F.col("y.first")) & ((F.col("y.c") == F.col("y.head")) | (F.col("x.doc_id") < F.col("y.doc_id")))
    pairs = pairs.filter(new & _meets_here() & _may_link(percent)).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
    more = verified(stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs"))
    final = stored(connected(links.unionAll(more)), "final")
    members = reps.join(final.select(F.col("id").alias("node"), F.col("component_id").alias("label")), "node")
    names = members.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = stored(members.join(names, "label").select("node", "component_id"), "members")
    class_of = reps.join(named, "node", "left").select("h", "g", F.coalesce("component_id", "rep").alias("component_id"))
    out = about.join(class_of, ["h", "g"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "t", "n", "h", "g", component.alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group: the smallest id, of its rows that with the least text hash.

    Rows are judged by id and text: where an id repeats with other texts each text is in its own group, and
    of rows that repeat both one stays. Null ids are in no group, but of their rows with one set of shingles one
    stays, none if a row with an id has that set. Rows without words all stay. All columns are kept.
    """
    rows = stored(_grouped(docs, k, percent).filter("n > 0"), "grouped")
    named = rows.filter("doc_id IS NOT NULL")
    heads = named.filter("doc_id = component_id").groupBy("component_id").agg(F.min("t").alias("first"))
    later = named.join(heads, "component_id", "left").filter("doc_id > component_id OR t <> first").select("doc_id", "t")
    nameless = rows.filter("doc_id IS NULL").groupBy("h", "g", "t").agg(F.count("*").alias("m"))
    taken = named.select("h", "g").distinct().withColumn("taken", F.lit(True))
    lead = nameless.groupBy("h", "g").agg(F.min("t").alias("first"))
    spare = nameless.join(lead, ["h", "g"]).join(taken, ["h", "g"], "left").filter("taken OR t <> first")
    gone = later.unionAll(spare.select(F.lit(None).cast("bigint").alias("doc_id"), "t"))
    # How often each (id, text) that repeats or goes may stay.
    again = rows.groupBy("doc_id", "t").agg(F.count("*").alias("m")).filter("m > 1").select("doc_id", "t", F.lit(1).alias("stay"))
    fates = again.unionAll(gone.select("doc_id", "t", F.lit(0).alias("stay"))).groupBy("doc_id", "t").agg(F.min("stay").alias("_stay"))
    fates = small_side(stored(fates.select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), "_stay"), "fates"))
    told = docs.withColumn("_key", key_of(F.col("text")))
    told = told.join(fates, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_t")), "left")
    once = told.filter("_stay IS NULL").select(*docs.columns)
    return once.unionAll(told.filter("_stay = 1").dropDuplicates(["_id", "_t"]).select(*docs.columns))
