from __future__ import annotations

import hashlib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywise.functions.order_stats import (
    Quantile,
    quantiles,
    rank_cuts,
    up_to_cut,
    value_bucket,
)
from tallywise.functions.values import small_table


def tie(identifier):
    return hashlib.md5(str(identifier).encode()).hexdigest() + ":" + str(identifier)


def skewed(seed, n=2000):
    """A third of the rows in one group, a third with one value, some below zero."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = "hot" if rng.random() < 0.34 else rng.choice("abc")
        draw = rng.random()
        value = 49.9 if draw < 0.34 else round(rng.lognormvariate(4, 1.2), 2)
        if draw > 0.95:
            value = -value
        rows.append((group, value, rng.randint(1, 5), i))
    return pd.DataFrame(rows, columns=["g", "x", "y", "id"])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quantiles_match_brute_force(spark, seed):
    frame = skewed(seed)
    wanted = [
        Quantile("median_x", "x"),
        Quantile("low", "x", 0.25),
        Quantile("high", "x", 0.8),
        Quantile("median_y", "y"),
    ]
    got = quantiles(spark.createDataFrame(frame), ["g"], wanted).toPandas().set_index("g")
    expected = frame.groupby("g").agg(
        median_x=("x", "median"),
        low=("x", lambda v: v.quantile(0.25)),
        high=("x", lambda v: v.quantile(0.8)),
        median_y=("y", "median"),
    )
    pd.testing.assert_frame_equal(got.sort_index(), expected, check_dtype=False, rtol=1e-12)


def test_neighbours_in_sparse_buckets(spark):
    # Every value in a bucket of its own, so both ends of an interpolation are first in theirs.
    df = spark.createDataFrame([(float(10**i),) for i in range(6)], "x double")
    row = quantiles(df, [], [Quantile("m", "x"), Quantile("q", "x", 0.3)]).first()
    assert row["m"] == (100 + 1000) / 2
    assert row["q"] == pytest.approx(10 + (100 - 10) * 0.5)


def test_quantiles_skip_nulls_and_handle_empty_input(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), ("a", 3.0)], "g string, x double")
    rows = {r["g"]: r["m"] for r in quantiles(df, ["g"], [Quantile("m", "x")]).collect()}
    assert rows == {"a": 2.0}
    empty = quantiles(df.filter("false"), [], [Quantile("m", "x")]).collect()
    assert [r["m"] for r in empty] == [None]


def test_bucket_never_decreases(spark):
    points = sorted(
        s * v for s in (-1, 1) for e in range(-30, 40) for v in (2.0**e, 1.0001 * 2.0**e, 1.7 * 2.0**e)
    ) + [0.0]
    df = spark.createDataFrame([(p,) for p in sorted(points)], "x double")
    buckets = [r["b"] for r in df.select("x", value_bucket(F.col("x")).alias("b")).orderBy("x").collect()]
    assert buckets == sorted(buckets)


@pytest.mark.parametrize("seed", [5, 6])
def test_rank_cuts_find_the_row_at_the_rank(spark, seed):
    frame = skewed(seed)
    frame["tie"] = [tie(i) for i in frame["id"]]
    df = spark.createDataFrame(frame[["g", "x", "id"]])
    wanted = []
    for group, rows in frame.groupby("g"):
        wanted += [(group, k, rank) for k, rank in enumerate((1, len(rows) // 2, len(rows)), 1)]
    cuts = small_table(spark, wanted, "g string, cut int, rank long")
    got = {
        (r["g"], r["cut"]): (r["cut_value"], r["cut_tie"])
        for r in rank_cuts(df, ["g"], F.col("x"), "id", cuts).collect()
    }
    for group, cut, rank in wanted:
        row = frame[frame.g == group].sort_values(["x", "tie"]).iloc[rank - 1]
        assert got[group, cut] == (row.x, row.tie)


def test_cut_splits_a_group_of_equal_values(spark):
    df = spark.createDataFrame([(i, 7.0) for i in range(500)], "id long, x double")
    cuts = rank_cuts(df, [], F.col("x"), "id", small_table(spark, [(1, 123)], "cut int, rank long"))
    inside = df.crossJoin(cuts).filter(
        up_to_cut(F.col("x"), F.col("id"), F.col("cut_value"), F.col("cut_tie"))
    )
    expected = sorted(range(500), key=tie)[:123]
    assert sorted(r["id"] for r in inside.collect()) == sorted(expected)


def test_quantiles_of_many_groups(spark):
    rows = spark.range(60_000).select(
        (F.col("id") % 12_000).alias("g"), (F.xxhash64("id") % 1000).cast("double").alias("v")
    )
    got = quantiles(rows, ["g"], [Quantile("q", "v", 0.25)], fixed_groups=False)
    want = rows.groupBy("g").agg(F.percentile("v", 0.25).alias("w"))
    both = got.join(want, "g")
    assert both.count() == 12_000
    assert both.where("abs(q - w) > 1e-9").count() == 0
