"""Numbers whose last digit decides a gate.

Scores are rounded half-to-even on the exact binary value (not on its printed
decimals) and means do not depend on the order of the rows.

Functions ending in ``_sql`` return Spark SQL text over an expression that should
be a plain column or field name, as it occurs several times in the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = "134217729D"  # 2**27 + 1, splits a double into two half-width parts


def scaled_round_sql(x: str, digits: int) -> str:
    """``x * 10**digits`` rounded to an integer (as a double), for x >= 0.

    ``p + e`` is the exact product of x with ``2 * 10**digits``: the scale has few
    significant bits, so both half-products are exact doubles.
    """
    if not 0 <= digits <= 7:
        raise ValueError("digits must be between 0 and 7")
    s = f"{2 * 10**digits}D"
    p = f"({x} * {s})"
    high = f"({x} * {_SPLIT} - ({x} * {_SPLIT} - {x}))"
    e = f"(({high} * {s} - {p}) + ({x} - {high}) * {s})"
    k = f"double(floor({p} / 2))"
    over_half = f"({p} - {k} * 2 - 1)"
    odd = f"{k} - double(floor({k} / 2)) * 2 = 1"
    return f"({k} + CASE WHEN {over_half} > -{e} OR ({over_half} = -{e} AND {odd}) THEN 1D ELSE 0D END)"


def round_exact_sql(x: str, digits: int = 4) -> str:
    return f"({scaled_round_sql(x, digits)} / {10**digits}D)"


def round_exact(x: str, digits: int = 4) -> Column:
    """The named column rounded to ``digits`` decimals."""
    return F.expr(round_exact_sql(x, digits))


def fixed_sql(x: str, digits: int) -> str:
    """Fixed-point text of a non-negative double, e.g. ``0.062`` for 0.0625."""
    k = f"bigint({scaled_round_sql(x, digits)})"
    if digits == 0:
        return f"string({k})"
    return f"concat({k} div {10**digits}, '.', lpad(string({k} % {10**digits}), {digits}, '0'))"


def fixed(x: str, digits: int) -> Column:
    return F.expr(fixed_sql(x, digits))


def percent_sql(x: str, digits: int = 0) -> str:
    return f"concat({fixed_sql(f'({x} * 100D)', digits)}, '%')"


def percent(x: str, digits: int = 0) -> Column:
    return F.expr(percent_sql(x, digits))


def as_exact(x: Column) -> Column:
    """A score as a decimal, so that sums do not depend on the order."""
    return x.cast("decimal(20,15)")


def exact_ratio(total: Column, n: Column) -> Column:
    """Mean from a decimal total and a row count; NULL when there are no rows."""
    return F.try_divide(total.cast("decimal(30,15)"), n.cast("decimal(19,0)")).cast("double")


def exact_mean(x: Column) -> Column:
    """Aggregate: order-independent mean of a double column."""
    return exact_ratio(F.sum(as_exact(x)), F.count(x))


def clamp01(x: Column) -> Column:
    """Bound to [0, 1]; NaN becomes 1.0 and NULL becomes 0.0."""
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.when(x.isNull(), 0.0).when(F.isnan(x), 1.0).otherwise(bounded)
