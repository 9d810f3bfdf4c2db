"""Arrays whose elements are costly to build."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for use inside ``body``.

    A column used inside a lambda may be inlined there by the optimizer and then
    be computed again for every element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), 0)


def explode_once(df: DataFrame, array: Column | str, out: str, pos: str | None = None) -> DataFrame:
    """One row per element of ``array``, as ``out`` (and its index as ``pos``).

    The outer form is used because the plain one makes the optimizer add a filter
    on the array's size below, which computes a costly array twice.
    """
    index = pos or "_index"
    rows = df.select("*", F.posexplode_outer(array).alias(index, out)).filter(F.col(index).isNotNull())
    return rows.withColumn(index, F.col(index).cast("bigint")) if pos else rows.drop(index)
