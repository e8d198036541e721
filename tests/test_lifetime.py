from __future__ import annotations

import pytest

from builders import as_dict, person, segmented
from tallywise.operators import lifetime, repeat_model
from tallywise.operators.lifetime import value_inputs

LOYAL, LOST, RISK = "Loyal Customers", "Lost Customers", "At-Risk Customers"


def inputs(spark, rows):
    return value_inputs(segmented(spark, rows))


def test_yearly_orders(spark):
    rows = [
        (person("steady", orders=4, tenure=730), LOYAL, 5, 4, 4),
        (person("burst", orders=3, tenure=2), LOYAL, 5, 3, 4),
        (person("same_day", orders=2, tenure=0), LOYAL, 5, 2, 4),
        (person("recent"), LOYAL, 4, 1, 1),
        (person("cooling"), LOYAL, 3, 1, 1),
        (person("lapsed"), LOST, 2, 1, 1),
    ]
    got = as_dict(inputs(spark, rows), "customer_unique_id", "yearly_orders")
    assert got == {
        "steady": 2.0, "burst": 12.0, "same_day": 2.0, "recent": 2.0, "cooling": 1.5, "lapsed": 1.0,
    }


def test_empirical_years(spark):
    rows = [
        (person("a", orders=2, tenure=365), LOYAL, 5, 2, 4),
        (person("b", orders=2, tenure=1095), LOYAL, 5, 2, 4),
        (person("c", orders=2, tenure=0), RISK, 5, 2, 4),
        (person("one"), LOYAL, 5, 1, 1),
        (person("two"), RISK, 5, 1, 1),
        (person("three"), LOST, 1, 1, 1),  # no repeat buyers here: median of all
    ]
    got = as_dict(inputs(spark, rows), "customer_unique_id", "lifespan_years")
    assert got == {"a": 1.0, "b": 3.0, "c": 0.5, "one": 2.0, "two": 0.5, "three": 1.0}


def test_nobody_came_back(spark):
    rows = [(person("a"), LOYAL, 5, 1, 1), (person("b"), LOST, 1, 1, 1)]
    assert set(as_dict(inputs(spark, rows), "customer_unique_id", "lifespan_years").values()) == {1.0}


def test_value_is_rounded_and_uses_unrounded_rates(spark):
    rows = [(person("a", orders=3, spend=100.01, tenure=700), LOYAL, 5, 3, 4)]
    frame = inputs(spark, rows)
    row = lifetime.clv_scores(frame).first()
    value = 100.01 / 3 * (3 / 700 * 365) * 0.65 * (700 / 365)
    assert row["clv_estimate"] == round(value, 2)
    assert row["annualized_frequency"] == round(3 / 700 * 365, 4)
    assert row["lifespan_method"] == "empirical" and row["prob_alive"] is None
    table = as_dict(lifetime.clv_sensitivity(frame), "gross_margin_assumption", "total_clv")
    assert set(table) == {0.5, 0.6, 0.65, 0.7} and table[0.65] == row["clv_estimate"]


def test_summary_lists_absent_segments_and_the_portfolio(spark):
    rows = [(person("a", spend=10), LOYAL, 5, 1, 1), (person("b", spend=30), LOST, 1, 1, 1)]
    summary = lifetime.clv_summary(lifetime.clv_scores(inputs(spark, rows)))
    sizes = as_dict(summary, "rfm_segment", "customers")
    assert sizes["Champions"] == 0 and sizes["All segments"] == 2
    shares = as_dict(summary, "rfm_segment", "clv_share_pct")
    assert shares["Champions"] is None
    assert shares[LOYAL] + shares[LOST] == pytest.approx(100, abs=0.1)


def test_model_years_fall_back_to_the_segment_then_to_a_constant(spark):
    rows = [
        (person("known", orders=3, recency=30, tenure=100), LOYAL, 5, 3, 4),
        (person("new", recency=0), LOYAL, 5, 1, 1),  # no observation period
        (person("lone", recency=0), RISK, 5, 1, 1),
    ]
    params = {"r": 0.9, "alpha": 120.0, "a": 0.6, "b": 2.5}
    alive = repeat_model.add_prob_alive(segmented(spark, rows), params)
    assert as_dict(alive, "customer_unique_id", "prob_alive")["new"] is None
    years = as_dict(lifetime.model_lifespan(alive), "customer_unique_id", "lifespan_years")
    assert years["new"] == years["known"] > 0.1
    assert years["lone"] == 0.5
