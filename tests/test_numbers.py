from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from runsieve.functions.numbers import clamp01, exact_mean, fixed, percent, round_exact, scaled_round_sql


def test_rounding_and_formats_match_python(spark):
    rng = random.Random(7)
    values = [0.84995, 0.12345, 0.00005, 0.0, 1.0, 0.125, 0.0625, 0.85, 1 / 3]
    values += [(2 * i + 1) / 20000 for i in range(10000)] + [rng.random() for _ in range(5000)]
    values += [rng.random() * 1e5 for _ in range(2000)] + [(2 * i + 1) / 128 for i in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select(
        "x", round_exact("x"), round_exact("x", 6), fixed("x", 3), fixed("x", 0), percent("x"), percent("x", 2)
    ).collect()
    for row in got:
        x = row[0]
        assert tuple(row)[1:] == (round(x, 4), round(x, 6), f"{x:.3f}", f"{x:.0f}", f"{x:.0%}", f"{x:.2%}")


def test_rounding_rejects_wide_scales():
    with pytest.raises(ValueError):
        scaled_round_sql("x", 9)


@pytest.mark.parametrize("n", [7, 1000])
def test_mean_does_not_depend_on_order_or_partitions(spark, n):
    df = spark.createDataFrame([(0.85,)] * n, "x double")
    for parts in (1, 4, 64):
        assert df.repartition(parts).agg(exact_mean(F.col("x"))).first()[0] == 0.85


def test_clamp(spark):
    rows = [(-0.1, 0.0), (1.2, 1.0), (0.9, 0.9), (None, 0.0), (float("nan"), 1.0), (float("inf"), 1.0), (float("-inf"), 0.0)]
    df = spark.createDataFrame(rows, "x double, want double")
    assert df.filter(clamp01(F.col("x")) != F.col("want")).count() == 0
