"""Uniform against segmented use of one retention budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.order_stats import Quantile, quantiles, rank_cuts, up_to_cut
from ..functions.values import exact_mean, per_cent, ratio, round_even, small_table
from ..params import (
    ELIGIBLE_MAX_RECENCY_SCORE,
    GROSS_MARGIN,
    INTERVENTIONS,
    RETENTION_BUDGET,
    SHARE_TOLERANCE,
    UNIFORM_RECOVERY_RATE,
    Intervention,
)
from ..sources.catalog import require_columns
from .segments import per_segment

REQUIRED = (
    "customer_unique_id",
    "rfm_segment",
    "R_score",
    "clv_estimate",
    "annualized_frequency",
    "avg_order_value",
)


def check_shares(plan: Sequence[Intervention] = INTERVENTIONS) -> None:
    total = sum(i.share for i in plan)
    if abs(total - 1.0) >= SHARE_TOLERANCE:
        raise ValueError(f"budget shares add up to {total}, not 1")


def intervention_table(
    spark: SparkSession, plan: Sequence[Intervention] = INTERVENTIONS
) -> DataFrame:
    """The plan's parameters, one row per segment."""
    return small_table(
        spark,
        [(i.segment, i.description, i.cost, i.share, i.effect, i.rate, i.base_rate) for i in plan],
        "rfm_segment string, intervention string, cost double, share double,"
        " effect string, rate double, base_rate double",
    )


def segment_sizes(scores: DataFrame) -> DataFrame:
    return scores.groupBy("rfm_segment").agg(
        F.count(F.lit(1)).alias("size"),
        F.count_if(F.col("R_score") <= ELIGIBLE_MAX_RECENCY_SCORE).alias("eligible"),
    )


def current_state(scores: DataFrame, budget: float = RETENTION_BUDGET) -> DataFrame:
    """The same coupon for everyone who has not bought for some time."""
    require_columns(scores, REQUIRED, "scored customers")
    medians = quantiles(scores, ["rfm_segment"], [Quantile("median_clv", "clv_estimate")])
    plan = per_segment(segment_sizes(scores), medians).na.fill(0, ["size", "eligible"])
    # Five rows: the window's single partition is as small as the result.
    everyone = F.sum("eligible").over(Window.partitionBy())
    cost = ratio(F.lit(float(budget)), everyone)
    spent = F.col("eligible") * cost
    recovered = F.col("eligible") * F.lit(UNIFORM_RECOVERY_RATE)
    revenue = recovered * F.col("median_clv")
    return plan.select(
        "rfm_segment",
        F.col("size").alias("total_customers"),
        F.col("eligible").alias("eligible_customers_current"),
        round_even(spent, 2).alias("current_budget_allocation"),
        round_even(cost, 2).alias("current_cost_per_customer"),
        round_even(recovered, 1).alias("current_expected_recovered"),
        round_even(revenue, 2).alias("current_revenue_impact"),
        round_even(ratio(revenue - spent, spent), 4).alias("roi_current"),
        round_even(F.col("median_clv"), 2).alias("median_clv"),
    )


def segment_reach(
    scores: DataFrame,
    budget: float = RETENTION_BUDGET,
    plan: Sequence[Intervention] = INTERVENTIONS,
) -> DataFrame:
    """Customers each segment's share of the budget pays for, at most all of them."""
    check_shares(plan)
    sizes = per_segment(segment_sizes(scores), intervention_table(scores.sparkSession, plan))
    allocated = F.lit(float(budget)) * F.col("share")
    # In doubles: 180000 x 0.35 / 9 is 6999.99..., and part customers are cut off.
    affordable = ratio(allocated, F.col("cost")).cast("long")
    size = F.coalesce("size", F.lit(0))
    reach = F.least(affordable, size)
    return sizes.select(
        "rfm_segment",
        size.alias("segment_size"),
        allocated.alias("allocated_budget"),
        "cost",
        reach.alias("reach"),
        round_even(F.coalesce(per_cent(reach, size), F.lit(0.0)), 1).alias("coverage_pct"),
    )


def targeted_customers(scores: DataFrame, reach: DataFrame) -> DataFrame:
    """The ``reach`` most valuable customers of each segment.

    Instead of ranking whole segments, the last customer reached is looked up in
    each; the rest is a filter against those few rows.
    """
    ends = reach.filter(F.col("reach") > 0).select(
        "rfm_segment", F.lit(1).alias("cut"), F.col("reach").alias("rank")
    )
    cuts = rank_cuts(
        scores, ["rfm_segment"], -F.col("clv_estimate"), "customer_unique_id", ends
    )
    inside = up_to_cut(
        -F.col("clv_estimate"), F.col("customer_unique_id"), F.col("cut_value"), F.col("cut_tie")
    )
    return scores.join(F.broadcast(cuts), "rfm_segment").filter(inside).select(
        "customer_unique_id",
        "rfm_segment",
        "clv_estimate",
        "avg_order_value",
        "annualized_frequency",
    )


def proposed_state(
    reach: DataFrame,
    targeted: DataFrame,
    plan: Sequence[Intervention] = INTERVENTIONS,
) -> DataFrame:
    """Expected effect of each segment's own intervention on those it reaches."""
    means = targeted.groupBy("rfm_segment").agg(
        exact_mean(F.col("clv_estimate"), 2).alias("mean_clv"),
        exact_mean(F.col("avg_order_value"), 10).alias("mean_aov"),
        exact_mean(F.col("annualized_frequency"), 4).alias("mean_frequency"),
    )
    medians = quantiles(targeted, ["rfm_segment"], [Quantile("median_clv", "clv_estimate")])
    table = per_segment(
        reach.drop("cost"), intervention_table(reach.sparkSession, plan), means, medians
    ).na.fill(0.0, ["mean_clv", "mean_aov", "mean_frequency", "median_clv"])

    n, rate = F.col("reach"), F.col("rate")
    effect = F.col("effect")

    def by_effect(churn: Column, uplift: Column, share: Column) -> Column:
        return (
            F.when(effect == "churn_reduction", churn)
            .when(effect == "frequency_uplift", uplift)
            .when(effect.isin("conversion_to_repeat", "recovery_rate"), share)
            .otherwise(0.0)
        )

    kept = n * (F.col("base_rate") - rate)
    extra_orders = n * F.col("mean_frequency") * rate
    won = n * rate
    retained = by_effect(kept, extra_orders, won)
    revenue = by_effect(
        kept * F.col("mean_clv"),
        extra_orders * F.col("mean_aov") * F.lit(GROSS_MARGIN),
        won * F.col("median_clv"),
    )
    spent = n * F.col("cost")
    return table.select(
        "rfm_segment",
        "intervention",
        round_even(F.col("allocated_budget"), 2).alias("proposed_budget_allocation"),
        F.col("cost").alias("proposed_cost_per_customer"),
        n.alias("proposed_reach"),
        F.col("coverage_pct").alias("proposed_coverage_pct"),
        round_even(retained, 1).alias("proposed_expected_retained"),
        round_even(revenue, 2).alias("proposed_revenue_impact"),
        round_even(ratio(revenue - spent, spent), 4).alias("roi_proposed"),
        round_even(F.col("mean_clv"), 2).alias("targeted_mean_clv"),
    )


def retention_roi(current: DataFrame, proposed: DataFrame) -> DataFrame:
    """Both plans side by side; what a plan lacks counts as 0."""
    return current.join(proposed, "rfm_segment", "full").na.fill(0)


def retention_headline(roi: DataFrame) -> DataFrame:
    """Portfolio totals: money protected, uplift and return on the full budget."""
    money = (
        "current_revenue_impact",
        "proposed_revenue_impact",
        "current_budget_allocation",
        "proposed_budget_allocation",
    )
    totals = roi.agg(*[F.sum(F.col(c).cast("decimal(18,2)")).cast("double").alias(c) for c in money])
    now, then, cost_now, cost_then = (F.col(c) for c in money)
    gain = then - now
    return totals.select(
        round_even(now, 2).alias("current_revenue"),
        round_even(then, 2).alias("proposed_revenue"),
        round_even(cost_now, 2).alias("current_budget"),
        round_even(cost_then, 2).alias("proposed_budget"),
        round_even(gain, 2).alias("additional_revenue"),
        round_even(F.when(now > 0, gain / now * 100).otherwise(0.0), 1).alias("uplift_pct"),
        round_even(ratio(now - cost_now, cost_now), 4).alias("current_portfolio_roi"),
        round_even(ratio(then - cost_then, cost_then), 4).alias("proposed_portfolio_roi"),
    )


def retention_checks(
    roi: DataFrame, plan: Sequence[Intervention] = INTERVENTIONS
) -> DataFrame:
    """Totals, coverage and completeness of the comparison."""
    holes = [F.count_if(F.col(c).isNull()) for c in roi.columns]
    total_share = sum(i.share for i in plan)
    return roi.agg(
        F.sum(F.col("current_budget_allocation").cast("decimal(18,2)")).cast("double").alias("current_budget"),
        F.sum(F.col("proposed_budget_allocation").cast("decimal(18,2)")).cast("double").alias("proposed_budget"),
        F.count(F.lit(1)).alias("segments"),
        sum(holes[1:], holes[0]).alias("null_values"),
    ).select(
        "*",
        round_even(F.lit(float(total_share)), 4).alias("share_total"),
        F.lit(abs(total_share - 1.0) < SHARE_TOLERANCE).alias("shares_ok"),
    )
