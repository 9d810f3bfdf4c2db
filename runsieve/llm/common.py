"""What the operators share: tables in the shared folder, size-checked broadcasts, exact text rules."""

from __future__ import annotations

import string
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runsieve.session import fresh_dir

#: Rows of a lookup side that may be broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase

#: Fixed value: the characters that the contracts strip and split on (space, tab to carriage return).
BLANKS = " \t\n\x0b\x0c\r"


def ship(module: str) -> None:
    """Send the functions of a module to the workers by value, so that they need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it again: the plan above it starts from files,
    which outlive a lost executor."""
    path = fresh_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored lookup table of narrow rows for broadcast if it has at most ``limit`` rows; a larger
    one is returned as it is and joins by a shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. The built-in ``lower`` has a fast path for pure ASCII and is right there."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def key_of(text: Column) -> Column:
    """Tells rows apart that repeat an id with another text."""
    return F.xxhash64(text)


def buckets_of(key: Column, n: int) -> Column:
    return F.pmod(key, F.lit(n)).cast("int")
