"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsieve.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    sideways = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return sideways.unionAll(least.select("a", F.col("m").alias("b")))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected(edges: DataFrame) -> DataFrame:
    """``(id, component_id)`` of every id that a link touches; component_id is the smallest id reachable.

    ``edges`` has long columns ``a`` and ``b``; direction, repeats and self-links do not matter, an end
    that is null is no link. Each round hangs the larger neighbours of an id, then the smaller ones, on
    its smallest neighbour until only stars are left: a logarithmic number of rounds in practice, each a
    partial aggregate and an equi-join whose hot keys adaptive execution splits. Every round is a
    written table, so a lost executor costs one round at most. An empty table gives an empty result.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = stored(edges, "edges"), None
    while (now := _mark(edges)) != before and now[0]:
        before = now
        edges = stored(_small_star(_large_star(edges).distinct()).distinct(), "edges")
    members = edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return members.unionAll(edges.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
