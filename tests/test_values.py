from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tallywise.functions.values import cap_at, currency, floor_at, ratio, round_even, small_table


def test_rounding_follows_numpy(spark):
    numbers = [1.015, 2.675, 0.125, 0.375, 2.5, -2.5, 1234.565, 1e9 + 0.005, 0.00005]
    df = spark.createDataFrame([(v,) for v in numbers], "x double")
    for places in (1, 2, 4):
        got = [r[0] for r in df.select(round_even(F.col("x"), places)).collect()]
        assert got == list(np.round(numbers, places))


def test_clips_keep_unknowns(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (20.0,)], "x double")
    rows = df.select(floor_at(F.col("x"), 0), cap_at(F.col("x"), 12)).collect()
    assert [tuple(r) for r in rows] == [(None, None), (0.0, -1.0), (20.0, 12.0)]


def test_ratio_is_zero_when_undefined(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(ratio(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 0.0]


def test_small_table_and_currency(spark):
    df = small_table(spark, [("a", 1234.5), ("b", None)], "k string, v double")
    assert df.select("k", currency(F.col("v"))).collect() == [("a", "R$1,234.50"), ("b", None)]
