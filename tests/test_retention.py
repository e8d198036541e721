from __future__ import annotations

import pytest

from builders import as_dict, person, segmented
from tallywise.operators import exports, lifetime, retention
from tallywise.params import INTERVENTIONS, SEGMENTS, Intervention

LOYAL, LOST, RISK = "Loyal Customers", "Lost Customers", "At-Risk Customers"


def scores(spark, rows):
    return lifetime.clv_scores(lifetime.value_inputs(segmented(spark, rows)))


@pytest.fixture(scope="module")
def few(spark):
    rows = [(person(f"l{i}", spend=100 + i), LOYAL, 4, 3, 3) for i in range(4)]
    rows += [(person(f"r{i}", spend=100.0), RISK, 2, 2, 3) for i in range(6)]
    rows += [(person(f"x{i}", spend=20.0), LOST, 1, 1, 1) for i in range(2)]
    return scores(spark, rows)


def test_uniform_plan_spends_the_whole_budget(few):
    plan = as_dict(
        retention.current_state(few, 800.0), "rfm_segment",
        "eligible_customers_current", "current_budget_allocation", "current_cost_per_customer",
    )
    assert plan[RISK] == (6, 600.0, 100.0) and plan[LOST] == (2, 200.0, 100.0)
    assert plan[LOYAL] == (0, 0.0, 100.0)
    assert sum(p[1] for p in plan.values()) == 800.0


def test_nobody_is_eligible(spark):
    rows = [(person("a"), LOYAL, 5, 3, 3), (person("b"), LOYAL, 4, 3, 3)]
    plan = as_dict(
        retention.current_state(scores(spark, rows)), "rfm_segment",
        "current_cost_per_customer", "roi_current",
    )
    assert set(plan.values()) == {(0.0, 0.0)}


def test_empty_segments_are_zero_in_the_comparison(few):
    current = retention.current_state(few)
    assert as_dict(current, "rfm_segment", "median_clv")["Champions"] is None
    reach = retention.segment_reach(few)
    proposed = retention.proposed_state(reach, retention.targeted_customers(few, reach))
    roi = retention.retention_roi(current, proposed)
    champion = roi.filter("rfm_segment = 'Champions'").first().asDict()
    assert champion["total_customers"] == 0 and champion["median_clv"] == 0
    assert champion["current_revenue_impact"] == 0 and champion["roi_proposed"] == 0
    assert len(roi.columns) == 18 and roi.count() == len(SEGMENTS)
    checks = retention.retention_checks(roi).first()
    assert checks["null_values"] == 0 and checks["segments"] == 5 and checks["shares_ok"]


def test_part_customers_are_cut_off_in_double_arithmetic(spark):
    rows = spark.range(8000).selectExpr(
        "cast(id as string) as customer_unique_id", "'Potential Loyalists' as rfm_segment",
        "4 as R_score",
    )
    reach = as_dict(retention.segment_reach(rows), "rfm_segment", "reach")
    assert reach["Potential Loyalists"] == 6999
    assert reach[LOST] == 0


def test_the_most_valuable_are_reached_first(few):
    # 48 % of 300 buys six At-Risk contacts, 15 % two Loyal ones.
    reach = retention.segment_reach(few, 300.0)
    assert as_dict(reach, "rfm_segment", "reach") == {
        "Champions": 0, LOYAL: 2, "Potential Loyalists": 0, RISK: 6, LOST: 0,
    }
    chosen = retention.targeted_customers(few, reach).collect()
    assert sorted(r["customer_unique_id"] for r in chosen if r["rfm_segment"] == LOYAL) == ["l2", "l3"]
    assert sum(r["rfm_segment"] == RISK for r in chosen) == 6


def test_ties_fill_the_reach_exactly(few):
    reach = retention.segment_reach(few, 150.0)
    chosen = retention.targeted_customers(few, reach).collect()
    assert sum(r["rfm_segment"] == RISK for r in chosen) == 3


def test_effects(few):
    reach = retention.segment_reach(few, 300.0)
    plan = as_dict(
        retention.proposed_state(reach, retention.targeted_customers(few, reach)),
        "rfm_segment", "proposed_expected_retained", "proposed_revenue_impact", "roi_proposed",
    )
    # Loyal: 2 reached, 2 orders a year each, 15 % more of them, order value 102.5.
    assert plan[LOYAL] == (0.6, round(0.6 * 102.5 * 0.65, 2), round((0.6 * 102.5 * 0.65 - 36) / 36, 4))
    value = 100.0 * 1.0 * 0.65 * 1.0
    assert plan[RISK] == (1.7, round(6 * 0.28 * value, 2), round((6 * 0.28 * value - 144) / 144, 4))
    assert plan[LOST] == (0.0, 0.0, 0.0)


def test_shares_must_add_up(few):
    broken = [*INTERVENTIONS[:-1], Intervention(LOST, "more", 1.0, 0.5, "none")]
    with pytest.raises(ValueError, match="shares"):
        retention.segment_reach(few, plan=broken)


def test_headline_uses_the_full_budget(few):
    reach = retention.segment_reach(few, 300.0)
    roi = retention.retention_roi(
        retention.current_state(few, 300.0),
        retention.proposed_state(reach, retention.targeted_customers(few, reach)),
    )
    row = retention.retention_headline(roi).first()
    assert row["proposed_budget"] == 300.0
    assert row["proposed_portfolio_roi"] == pytest.approx(row["proposed_revenue"] / 300 - 1, abs=1e-4)
    shift = exports.retention_comparison(roi).agg({"budget_shift": "sum"}).first()[0]
    assert shift == pytest.approx(0, abs=0.05)
