from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from builders import as_dict, base_table, person
from tallywise.operators import scoring
from tallywise.params import SEGMENTS


def test_recency_and_frequency_bands(spark):
    days = {0: 5, 30: 5, 31: 4, 60: 4, 61: 3, 90: 3, 91: 2, 150: 2, 151: 1, 2000: 1}
    df = spark.createDataFrame([(d,) for d in days], "d int")
    assert as_dict(df.select("d", scoring.recency_score(F.col("d")).alias("s")), "d", "s") == days
    orders = {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 40: 5}
    df = spark.createDataFrame([(o,) for o in orders], "o int")
    assert as_dict(df.select("o", scoring.frequency_score(F.col("o")).alias("s")), "o", "s") == orders


def monetary(spark, spends):
    people = [person(f"p{i}", spend=s) for i, s in enumerate(spends)]
    return as_dict(scoring.score(base_table(spark, people)), "customer_unique_id", "M_score")


def test_spend_bins_are_closed_on_the_right(spark):
    got = monetary(spark, [1, 2, 3, 4, 5, 6])
    assert [got[f"p{i}"] for i in range(6)] == [1, 1, 2, 3, 4, 5]


@pytest.mark.parametrize("seed", [1, 2])
def test_spend_bins_equal_quantile_bins(spark, seed):
    rng = np.random.default_rng(seed)
    spends = np.round(rng.lognormal(4, 1, 333), 2)
    got = monetary(spark, spends)
    expected = pd.qcut(pd.Series(spends), 5, labels=[1, 2, 3, 4, 5]).astype(int)
    assert [got[f"p{i}"] for i in range(333)] == list(expected)


@pytest.mark.parametrize(
    "n, expected",
    [
        (7, [1, 1, 2, 3, 4, 5, 5]),
        (12, [1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 5]),
        (13, [1, 1, 1, 2, 2, 3, 3, 3, 4, 4, 5, 5, 5]),
    ],
)
def test_equal_spends_are_split_by_rank(spark, n, expected):
    spends = [50.0] * (n - 2) + [1.0, 99.0]
    got = monetary(spark, spends)

    def place(i):
        name = f"p{i}"
        return spends[i], hashlib.md5(name.encode()).hexdigest() + ":" + name

    assert [got[f"p{i}"] for i in sorted(range(n), key=place)] == expected


def test_one_person_and_nobody(spark):
    assert monetary(spark, [10.0]) == {"p0": 1}
    assert monetary(spark, []) == {}


@pytest.fixture(scope="module")
def cells(spark):
    grid = [(r, f, m) for r in range(1, 6) for f in range(1, 6) for m in range(1, 6)]
    df = spark.createDataFrame(grid, "R_score int, F_score int, M_score int")
    return scoring.segment_scored(df)


def test_all_125_cells_by_rule_or_catch_all(cells):
    rows = cells.withColumn("rule", scoring.matched_segment()).collect()
    by_rule = Counter(r["rule"] for r in rows)
    assert [by_rule[s] for s in SEGMENTS] == [15, 35, 18, 27, 14]
    fallen = {
        (r["R_score"], r["F_score"], r["M_score"]): (r["rfm_composite"], r["rfm_segment"])
        for r in rows
        if r["rule"] is None
    }
    assert fallen == {
        (3, 1, 2): (2.05, "At-Risk Customers"),
        (3, 1, 3): (2.30, "At-Risk Customers"),
        (3, 2, 1): (2.15, "At-Risk Customers"),
        (3, 2, 2): (2.40, "At-Risk Customers"),
        (3, 3, 1): (2.50, "At-Risk Customers"),
        (4, 1, 1): (2.20, "At-Risk Customers"),
        (4, 1, 2): (2.45, "At-Risk Customers"),
        (3, 3, 2): (2.75, "Potential Loyalists"),
        (3, 4, 1): (2.85, "Potential Loyalists"),
        (4, 3, 1): (2.90, "Potential Loyalists"),
        (4, 2, 5): (3.55, "Loyal Customers"),
        (5, 1, 5): (3.60, "Loyal Customers"),
        (5, 2, 3): (3.45, "Loyal Customers"),
        (5, 2, 4): (3.70, "Loyal Customers"),
        (5, 2, 5): (3.95, "Loyal Customers"),
        (3, 5, 5): (4.20, "Champions"),
    }


def test_composite_equals_the_weighted_float_form(cells):
    for r in cells.collect():
        direct = np.round(r["R_score"] * 0.40 + r["F_score"] * 0.35 + r["M_score"] * 0.25, 2)
        assert r["rfm_composite"] == direct


def test_midpoint_tie_goes_to_the_earlier_segment(spark):
    df = spark.createDataFrame([(4.0,), (2.0,)], "rfm_composite double")
    got = as_dict(df.select("rfm_composite", scoring.nearest_segment().alias("s")), "rfm_composite", "s")
    assert got == {4.0: "Champions", 2.0: "At-Risk Customers"}
