"""Lexical passage ranking, per case and over a shared corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from runsieve.functions.arrays import let
from runsieve.functions.text import alnum_tokens, shared_count, strip
from runsieve.operators.ranking import materialise

_TEXTS = "array<string>"


def merged_corpus(expected: Column, recorded: Column) -> Column:
    """Both passage lists, stripped, blanks dropped, first copy kept."""
    both = F.concat(F.coalesce(expected, F.array().cast(_TEXTS)), F.coalesce(recorded, F.array().cast(_TEXTS)))
    return F.array_distinct(F.filter(F.transform(both, strip), lambda x: x != ""))


def rank_case_passages(cases: DataFrame, k: int = 4, out: str = "passages", only: Column | None = None) -> DataFrame:
    """Rank a case's own passages for its query and keep the first ``k``.

    Score is shared tokens / sqrt(passage tokens); ties keep corpus order and
    passages with score 0 may fill up to ``k``. Without query tokens the first
    ``k`` passages are kept. Row-local: no shuffle. Rows on which ``only`` is not
    true are not ranked and get NULL.
    """
    recorded = F.col("recorded_trace")["retrieved_contexts"]

    def tokenised(passage: Column, pos: Column) -> Column:
        return F.struct(pos.alias("pos"), passage.alias("passage"), alnum_tokens(passage).alias("tokens"))

    def scored(query_tokens: Column, p: Column) -> Column:
        size = F.greatest(F.size(p["tokens"]), F.lit(1)).cast("double")
        score = shared_count(query_tokens, p["tokens"]) / F.sqrt(size)
        return F.struct((-score).alias("minus"), p["pos"].alias("pos"), p["passage"].alias("passage"))

    # Without query tokens every score is 0, so the corpus order stays.
    passages = F.transform(merged_corpus(F.col("expected_contexts"), recorded), tokenised)
    ranked = let(alnum_tokens(F.col("query")), lambda q: F.array_sort(F.transform(passages, lambda p: scored(q, p))))
    first = F.transform(F.slice(ranked, 1, k), lambda s: s["passage"])
    return cases.withColumn(out, first if only is None else F.when(only, first))


class _QueryBlock:
    """Token postings of one bounded block of queries, as arrays."""

    def __init__(self, ids: list, token_lists: list[list[str]]):
        self.ids = np.array(ids)
        vocab: dict[str, int] = {}
        token_no, query_no = [], []
        for q, tokens in enumerate(token_lists):
            for token in tokens:
                token_no.append(vocab.setdefault(token, len(vocab)))
                query_no.append(q)
        order = np.argsort(np.array(token_no, dtype=np.int64), kind="stable")
        self.vocab = vocab
        self.queries = np.array(query_no, dtype=np.int64)[order]
        counts = np.bincount(np.array(token_no, dtype=np.int64), minlength=len(vocab)) if vocab else np.zeros(0, int)
        self.start = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def scores(self, token_lists: list) -> np.ndarray:
        """Score matrix of a batch of passages against every query of the block."""
        n_docs, n_queries = len(token_lists), len(self.ids)
        lookup = self.vocab.get
        hits = [np.array([t for t in map(lookup, tokens) if t is not None], dtype=np.int64) for tokens in token_lists]
        overlap = np.zeros((n_docs, n_queries))
        for row, tokens in enumerate(hits):
            if len(tokens):
                picked = np.concatenate([self.queries[self.start[t] : self.start[t + 1]] for t in tokens])
                overlap[row] = np.bincount(picked, minlength=n_queries)
        sizes = np.array([len(t) for t in token_lists], dtype=np.float64)
        return overlap / np.sqrt(np.maximum(sizes, 1.0))[:, None]


def _first_k(query: np.ndarray, score: np.ndarray, passage: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the best ``k`` passages of every query, ties by passage id."""
    ids = passage if passage.dtype != object else np.unique(passage.astype(str), return_inverse=True)[1]
    order = np.lexsort((ids, -score, query))
    ordered = query[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
    rank = np.arange(len(ordered)) - np.repeat(starts, np.diff(np.r_[starts, len(ordered)]))
    return order[rank < k]


def _task_top_k(block, k: int, rows_per_step: int):
    """Build the map function that keeps the best ``k`` passages per query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries: _QueryBlock = block.value
        best = None
        for batch in batches:
            for at in range(0, len(batch), rows_per_step):
                part = batch.iloc[at : at + rows_per_step]
                scores = queries.scores(part["tokens"].tolist())
                doc, query = np.nonzero(scores)
                found = (query, scores[doc, query], part["passage_id"].to_numpy()[doc])
                if best is not None:
                    found = tuple(np.concatenate(pair) for pair in zip(best, found, strict=True))
                keep = _first_k(*found, k)
                best = tuple(values[keep] for values in found)
        if best is not None:
            yield pd.DataFrame({"query_id": queries.ids[best[0]], "passage_id": best[2], "score": best[1]})

    return run


def lexical_top_k(
    queries: DataFrame, passages: DataFrame, k: int = 4, max_block_tokens: int = 2_000_000
) -> DataFrame:
    """Best ``k`` passages of a shared corpus for every query, scores above 0 only.

    ``queries`` is (query_id, query), ``passages`` (passage_id, text); ids are
    integers and break ties. Every task reads its own passages once, keeps k rows
    per query and ships only those, so no (query, passage) pair is shuffled and a
    token that occurs everywhere costs no more than any other.

    The query side is broadcast in blocks: its total token count is measured
    first and split into as many blocks as it takes to stay below
    ``max_block_tokens`` each. One block is the usual case; more blocks mean more
    passes over the corpus, never fewer results. With more than one, a block's
    rows are checkpointed and its broadcast is dropped before the next one is
    built, so driver and executors never hold two.
    """
    spark = queries.sparkSession
    tokenised = queries.select("query_id", alnum_tokens(F.col("query")).alias("tokens")).filter(F.size("tokens") > 0)
    total = tokenised.agg(F.sum(F.size("tokens"))).first()[0] or 0
    n_blocks = max(1, -(-int(total) // max_block_tokens))
    corpus = passages.select("passage_id", alnum_tokens(F.col("text")).alias("tokens")).filter(F.size("tokens") > 0)
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, " + (
        f"passage_id {passages.schema['passage_id'].dataType.simpleString()}, score double"
    )
    partial = None
    for number in range(n_blocks):
        member = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == number
        rows = (tokenised.filter(member) if n_blocks > 1 else tokenised).collect()
        if not rows:
            continue
        block = spark.sparkContext.broadcast(_QueryBlock([r[0] for r in rows], [r[1] for r in rows]))
        # Keep the dense score matrix of one step near 64 MB.
        step = max(1, 8_000_000 // len(rows))
        found = corpus.mapInPandas(_task_top_k(block, k, step), schema)
        if n_blocks > 1:
            found = materialise(found)
            block.destroy()
        partial = found if partial is None else partial.unionByName(found)
    if partial is None:
        return spark.createDataFrame([], schema + ", rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "passage_id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
