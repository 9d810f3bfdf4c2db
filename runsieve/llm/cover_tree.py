"""All pairs of vectors within a cosine threshold by dual traversal of a cover tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsieve.llm.common import ship, small_side, stored
from runsieve.llm.components import connected

ship(__name__)

#: Vectors in the sample that gives the centres of the tree (by smallest hash of the id). Every vector is
#: placed and compared; the sample only shapes the nodes.
SAMPLE = 1024
#: Vectors of a block; a task compares two blocks.
BLOCK = 8192
#: Allowance for rounding in distance bounds.
SLACK = 1e-6
_SLAB = 512
_CLEAN = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("vec", pa.binary())])


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles, not yet scaled; those that link with nothing are left out."""
    for batch in batches:
        ids, dims, out = [], [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            if i is None or not v.is_valid or v.values.null_count or not len(v.values):
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(x).all() and x.any():
                ids.append(i)
                dims.append(len(x))
                out.append((x + 0.0).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], schema=_CLEAN)


def unit(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def chord(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))


class Tree:
    """Nested levels of centres with halving radii over one sample of unit vectors.

    Level 0 has one centre; each level keeps the centres above and adds points farther than its radius
    from all of them. ``parent[l][i]`` is the centre of level l-1 nearest to centre i of level l.
    """

    def __init__(self, points: np.ndarray, last_radius: float):
        chosen, self.parent, self.sizes = [0], [np.zeros(1, int)], [1]
        near = chord(points @ points[0])
        radius = 1.0
        while True:
            above = len(chosen)
            while (far := np.flatnonzero(near > radius)).size:
                chosen.append(int(far[0]))
                near = np.minimum(near, chord(points @ points[far[0]]))
            self.parent.append(np.argmax(points[chosen] @ points[chosen[:above]].T, axis=1))
            self.sizes.append(len(chosen))
            if radius <= last_radius:
                break
            radius /= 2
        self.centres = points[chosen]
        #: Leaves in depth-first order.
        path = [np.arange(len(chosen))]
        for up in reversed(self.parent[1:]):
            path.append(up[path[-1]])
        self.order = np.lexsort(path)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each vector and the distance to its centre."""
        leaf, dist = np.empty(len(x), int), np.empty(len(x))
        for lo in range(0, len(x), 4096):
            cos = x[lo : lo + 4096] @ self.centres.T
            leaf[lo : lo + 4096] = best = cos.argmax(axis=1)
            dist[lo : lo + 4096] = chord(cos[np.arange(len(best)), best])
        return leaf, dist

    def close_leaves(self, radius: np.ndarray, eps: float) -> np.ndarray:
        """Pairs of leaves (i <= j) that may hold a pair of vectors within ``eps``: dual traversal from the
        root, where a pair of nodes whose centres are farther apart than ``eps`` plus both covering radii
        is dropped with all below it. ``radius`` is the covering radius of each leaf (below 0: empty)."""
        cover = [radius]
        for level in range(len(self.parent) - 1, 0, -1):
            up, down = self.parent[level], cover[0]
            gap = chord(np.einsum("ij,ij->i", self.centres[: len(up)], self.centres[up]))
            here = np.full(self.sizes[level - 1], -1.0)
            np.maximum.at(here, up, np.where(down >= 0, gap + down, -1.0))
            cover.insert(0, here)
        cos = self.centres @ self.centres.T
        pairs = np.zeros((1, 2), int)
        for level in range(1, len(self.parent)):
            up, reach = self.parent[level], cover[level]
            # Children of each centre, one after the other.
            kids = np.flatnonzero(reach >= 0)
            kids = kids[np.argsort(up[kids], kind="stable")]
            count = np.bincount(up[kids], minlength=self.sizes[level - 1])
            first = np.cumsum(count) - count
            p, q = pairs.T
            size = count[p] * count[q]
            nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            p, q = np.repeat(p, size), np.repeat(q, size)
            i, j = kids[first[p] + nth // count[q]], kids[first[q] + nth % count[q]]
            keep = ((p != q) | (i <= j)) & ((i == j) | (chord(cos[i, j]) <= eps + reach[i] + reach[j] + SLACK))
            pairs = np.column_stack((i[keep], j[keep]))
        return pairs


def _sample_trees(vectors: DataFrame, eps: float) -> dict[int, Tree]:
    """A tree per dimension over the bounded sample."""
    picked = vectors.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).toArrow()
    by_dim: dict[int, list[bytes]] = {}
    for dim, vec in zip(picked.column("dim").to_pylist(), picked.column("vec").to_pylist()):
        by_dim.setdefault(dim, []).append(vec)
    return {dim: Tree(unit(rows), eps / 4) for dim, rows in by_dim.items()}


def _placed(trees, eps: float):
    schema = pa.schema([("rep", pa.int64()), ("w", pa.int64()), ("dim", pa.int32()), ("vec", pa.binary()), ("node", pa.int32()), ("dist", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                if (tree := trees.value.get(int(dim))) is None:
                    # No sampled vector has this dimension: one leaf without bounds.
                    node, dist = np.zeros(len(part), int), np.full(len(part), 2.0)
                else:
                    leaf, dist = tree.place(unit(part.column(3).to_pylist()))
                    node = leaf * 2 + (dist <= eps / 2 - SLACK)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(node, pa.int32()), pa.array(dist, pa.float64())], schema=schema)

    return run


def _plan(spark: SparkSession, nodes: list, trees: dict[int, Tree], eps: float) -> tuple[DataFrame, DataFrame]:
    """Bins of nodes with their number of blocks, and the pairs of bins to compare.

    Works on node summaries: at most two nodes per sampled vector and dimension, whatever the table holds.
    A node of leaf l has number 2 l for its rim and 2 l + 1 for its core, the vectors so close to the
    centre that all of them link with each other. Large nodes are bins alone, small ones share bins in
    tree order.
    """
    bins, pairs = [], []
    for dim in sorted({r["dim"] for r in nodes}):
        mine = {r["node"]: r for r in nodes if r["dim"] == dim}
        tree, first = trees.get(dim), len({b[2] for b in bins})
        order = [n for leaf in (tree.order if tree else [0]) for n in (2 * int(leaf), 2 * int(leaf) + 1) if n in mine]
        number, room, at = first - 1, 0, {}
        for n in order:
            count = mine[n]["n"]
            if count > room:
                number += 1
                room = BLOCK if count <= BLOCK // 2 else 0
            room -= min(count, room)
            at[n] = number
        total: dict[int, int] = {}
        for n, b in at.items():
            total[b] = total.get(b, 0) + mine[n]["n"]
        alone_core = {b for b in total if [n % 2 for n in at if at[n] == b] == [1]}
        bins += [(dim, n, b, -(-total[b] // BLOCK)) for n, b in at.items()]
        if tree:
            radius = np.full(len(tree.centres), -1.0)
            for n, r in mine.items():
                radius[n // 2] = max(radius[n // 2], r["r"])
            close = tree.close_leaves(radius, eps)
            table = np.full((len(radius), 2), -1)
            for n, b in at.items():
                table[n // 2, n % 2] = b
            for i in (0, 1):
                for j in (0, 1):
                    p, q = table[close[:, 0], i], table[close[:, 1], j]
                    pairs.append(np.sort(np.column_stack((p, q))[(p >= 0) & (q >= 0)], axis=1))
        else:
            pairs.append(np.array([[first, first]]))
        skip = np.array(sorted(alone_core), int)
        pairs = [p[~((p[:, 0] == p[:, 1]) & np.isin(p[:, 0], skip))] for p in pairs]
    blocks = {b: m for _, _, b, m in bins}
    found = np.unique(np.concatenate(pairs), axis=0).tolist() if pairs else []
    both = [(p, q, blocks[p], blocks[q]) for p, q in found]
    bin_rows = spark.createDataFrame(bins, "dim int, node int, bin int, blocks int")
    return bin_rows, spark.createDataFrame(both, "p int, q int, p_blocks int, q_blocks int")


def _roots(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i and j in ``parent``; the smaller row number is the root."""
    while i.size:
        p, q = parent[i], parent[j]
        open_ = p != q
        i, j, p, q = i[open_], j[open_], p[open_], q[open_]
        np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def _compare(threshold: float):
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("rep", "ascending")])
        same = key[0].as_py() == key[2].as_py() and key[1].as_py() == key[3].as_py()
        split = int(np.searchsorted(table.column("side").to_numpy(), 1))
        rep, w, node = (table.column(c).to_numpy() for c in ("rep", "w", "node"))
        # Sets are kept over the rows in order of their ids, so that the smallest id is the root.
        by_id = np.argsort(rep, kind="stable")
        links, parent, where = np.zeros(len(rep), np.int64), np.arange(len(rep)), np.argsort(by_id, kind="stable")
        if len(rep) and (same or 0 < split < len(rep)):
            x = unit(table.column("vec").to_pylist())
            single = x.astype(np.float32)
            start, stop = (0, len(rep)) if same else (0, split)
            for lo in range(start, stop, _SLAB):
                hi = min(lo + _SLAB, stop)
                base = lo if same else split
                i, j = np.nonzero(single[lo:hi] @ single[base:].T >= np.float32(threshold - 1e-4))
                i, j = i + lo, j + base
                keep = ((node[i] != node[j]) | (node[i] % 2 == 0)) & ((i < j) if same else True)
                i, j = i[keep], j[keep]
                exact = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], x[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.empty(0)])
                i, j = i[exact >= threshold], j[exact >= threshold]
                links += np.bincount(i, w[j], len(rep)).astype(np.int64) + np.bincount(j, w[i], len(rep)).astype(np.int64)
                _roots(parent, where[i], where[j])
        got = links > 0
        return pa.table([pa.array(rep[got]), pa.array(links[got]), pa.array(rep[by_id][parent[where]][got])], schema=schema)

    return run


def linked_vectors(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Per row of ``vectors`` ``vec_id, n_links, component_id, kept`` under cosine >= ``threshold``.

    Equal vectors are one class with a weight. A bounded sample gives the nested centres; every class is
    placed at its nearest leaf, and leaf pairs are pruned by covering radii in a dual traversal of the
    node summaries. Surviving pairs are compared block by block, in double precision where single
    precision comes near the threshold, one task for two blocks of at most BLOCK vectors each; a task
    returns link counts and a local root per vector, never pairs. Vectors in the core of a leaf, within
    half the radius of its centre, all link with each other by the triangle inequality: they are counted
    in closed form, so a group of close copies of any size is linear. Data without clusters leave little
    to prune; all pairs of blocks are then compared, as exactness asks.

    Vectors that are null, empty, zero or hold null or non-finite components, or that have a null id, link
    with nothing; ids are long integers. Vectors of different length do not link. Rows that repeat an id are
    one vector, that of the shortest and then smallest bytes, and each row stays in the result. Extra
    columns are ignored. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    eps = float(np.sqrt(2 - 2 * threshold))
    vectors = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    clean = vectors.mapInArrow(_clean, "vec_id bigint, dim int, vec binary").groupBy("vec_id").agg(F.min(F.struct("dim", "vec")).alias("v"))
    clean = stored(clean.select("vec_id", "v.dim", "v.vec"), "vectors")
    classes = stored(clean.groupBy("dim", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w")).select("rep", "w", "dim", "vec"), "classes")
    trees = _sample_trees(classes, eps)
    shared = spark.sparkContext.broadcast(trees)
    schema = "rep bigint, w bigint, dim int, vec binary, node int, dist double"
    placed = stored(classes.mapInArrow(_placed(shared, eps), schema), "placed")
    nodes = placed.groupBy("dim", "node").agg(F.count("*").alias("n"), F.max("dist").alias("r"), F.sum("w").alias("w"), F.min("rep").alias("low"))
    nodes = stored(nodes, "nodes")
    bins, pairs = _plan(spark, nodes.collect(), trees, eps)
    rows = placed.join(F.broadcast(bins), ["dim", "node"])
    chunk = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).cast("int").alias("chunk")
    rows = rows.select("rep", "w", F.col("vec"), "node", "bin", chunk)
    cols = ["rep", "w", "vec", "node"]
    p = rows.join(F.broadcast(pairs), F.col("bin") == F.col("p"))
    first = F.when(F.col("p") == F.col("q"), F.col("chunk")).otherwise(F.lit(0))
    left = p.select(*cols, "p", F.col("chunk").alias("i"), "q", F.explode(F.sequence(first, F.col("q_blocks") - 1)).alias("j"), F.lit(0).alias("side"))
    q = rows.join(F.broadcast(pairs), F.col("bin") == F.col("q"))
    last = F.when(F.col("p") == F.col("q"), F.col("chunk") - 1).otherwise(F.col("p_blocks") - 1)
    right = q.filter((F.col("p") != F.col("q")) | (F.col("chunk") > 0)).select(
        *cols, "p", F.explode(F.sequence(F.lit(0), last)).alias("i"), "q", F.col("chunk").alias("j"), F.lit(1).alias("side")
    )
    tasks = left.unionAll(right).groupBy("p", "i", "q", "j")
    found = stored(tasks.applyInArrow(_compare(threshold), "rep bigint, links bigint, root bigint"), "found")
    core = nodes.filter("node % 2 = 1").select("dim", "node", F.col("w").alias("cw"), "low")
    cores = placed.join(F.broadcast(core), ["dim", "node"]).select("rep", (F.col("cw") - F.col("w")).alias("links"), F.col("low").alias("root"))
    sums = found.unionAll(cores).groupBy("rep", "root").agg(F.sum("links").alias("links"))
    sums = stored(sums, "sums")
    groups = connected(sums.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = sums.groupBy("rep").agg(F.sum("links").alias("links"))
    of_class = classes.join(counts, "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left").select(
        "dim", "vec", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")
    )
    valid = clean.join(of_class, ["dim", "vec"]).select("vec_id", "n_links", "component_id")
    component = F.coalesce("component_id", "vec_id")
    return vectors.join(valid, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
