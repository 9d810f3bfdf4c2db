"""From raw documents to training shards: five operators in a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsieve.llm import decontam, language_mix, mixing, ngram_join, sharding
from runsieve.llm.common import read_table, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORDS, PERCENT, SHARDS = 5, 80, 24

#: No SQL: the language model is learned by sampling and expectation-maximisation.
ORACLE_SQL = None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is undetermined (no letter, or null text)."""
    return language_mix.identified(docs).select(COLUMNS)


def unrepeat(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near copies."""
    return ngram_join.keep_one(docs, WORDS, PERCENT).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with benchmark passages."""
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents to the target weights of their sources, in a global random order."""
    return mixing.mix(docs).select(COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the records into shards and shuffle each."""
    return sharding.shuffle_into_shards(docs, SHARDS).select(*COLUMNS, F.lit("key").alias("law"), "shard", "slot")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify),
    ("ngram_join", unrepeat),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read as the next one's input."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
