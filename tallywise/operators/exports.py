"""Flat tables for dashboards, and the figures behind the charts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.order_stats import Quantile, quantiles
from ..functions.values import exact_mean, exact_sum, per_cent, round_even, small_table
from .segments import per_segment, with_sort_order

# Columns of the customer detail in published order.
DETAIL_COLUMNS = (
    "customer_unique_id", "customer_state", "rfm_segment",
    "R_score", "F_score", "M_score", "rfm_composite",
    "total_orders", "total_spend", "avg_order_value",
    "recency_days", "customer_tenure_days",
    "clv_estimate", "annualized_frequency", "estimated_lifespan_years",
    "first_purchase_date", "last_purchase_date",
    "avg_review_score", "primary_category", "primary_seller_state",
)
NO_SELLER_STATE = "Unknown"


def _two(column: str) -> Column:
    return round_even(F.col(column).cast("double"), 2).alias(column)


def customer_detail(scores: DataFrame) -> DataFrame:
    """Export 1: every scored customer."""
    return with_sort_order(scores.select(*DETAIL_COLUMNS)).select(
        *DETAIL_COLUMNS, "segment_sort_order"
    )


def segment_summary(scores: DataFrame) -> DataFrame:
    """Export 2: fifteen aggregates per segment; shares use the rounded totals.

    Segments are listed in order; one without customers is a row of nulls.
    """
    few = {
        "median_recency": "recency_days",
        "median_orders": "total_orders",
        "median_r_score": "R_score",
        "median_f_score": "F_score",
        "median_m_score": "M_score",
        "median_composite": "rfm_composite",
    }
    sums = scores.groupBy("rfm_segment").agg(
        F.count("customer_unique_id").alias("customer_count"),
        exact_sum(F.col("clv_estimate"), 2).alias("total_clv"),
        exact_mean(F.col("clv_estimate"), 2).alias("mean_clv"),
        exact_sum(F.col("total_spend"), 2).alias("total_spend"),
        *[F.median(c).alias(name) for name, c in few.items()],
    )
    spread = quantiles(scores, ["rfm_segment"], [
        Quantile("median_clv", "clv_estimate"),
        Quantile("p25_clv", "clv_estimate", 0.25),
        Quantile("p75_clv", "clv_estimate", 0.75),
        Quantile("median_spend", "total_spend"),
        Quantile("median_aov", "avg_order_value"),
    ])
    measures = [
        "total_clv", "median_clv", "mean_clv", "p25_clv", "p75_clv",
        "total_spend", "median_spend", "median_recency", "median_orders", "median_aov",
        "median_r_score", "median_f_score", "median_m_score", "median_composite",
    ]
    rounded = per_segment(sums, spread).select(
        "rfm_segment", "segment_sort_order", "customer_count", *[_two(c) for c in measures]
    )
    # Five rows.
    all_segments = Window.partitionBy()
    customers = F.sum("customer_count").over(all_segments)
    value = F.sum(F.col("total_clv").cast("decimal(28,2)")).over(all_segments).cast("double")
    present = F.col("customer_count").isNotNull()
    return rounded.orderBy("segment_sort_order").select(
        "rfm_segment",
        "customer_count",
        *measures,
        round_even(per_cent(F.col("customer_count"), customers), 1).alias("customer_pct"),
        round_even(per_cent(F.col("total_clv"), value), 1).alias("clv_share_pct"),
        F.when(present, F.col("segment_sort_order")).alias("segment_sort_order"),
    )


def retention_comparison(roi: DataFrame) -> DataFrame:
    """Export 3: both retention plans and what moves between them."""
    plans = with_sort_order(roi)

    def shift(column: str) -> Column:
        return F.col(f"proposed_{column}") - F.col(f"current_{column}")

    return plans.select(
        "*",
        round_even(shift("budget_allocation"), 4).alias("budget_shift"),
        round_even(shift("revenue_impact"), 4).alias("revenue_shift"),
        round_even(F.col("roi_proposed") - F.col("roi_current"), 4).alias("roi_improvement"),
    ).orderBy("segment_sort_order")


def sensitivity_export(sensitivity: DataFrame) -> DataFrame:
    """Export 4: margin scenarios with the margin as a whole percentage."""
    percent = (F.col("gross_margin_assumption") * 100).cast("int")
    return with_sort_order(sensitivity).withColumn("margin_pct", percent)


def geographic_summary(scores: DataFrame) -> DataFrame:
    """Export 5: value, activity and seller geography per customer state."""
    local = F.coalesce(F.col("customer_state") == F.col("primary_seller_state"), F.lit(False))
    located = scores.filter(F.col("customer_state").isNotNull())
    sums = located.groupBy("customer_state").agg(
        F.count("customer_unique_id").alias("customer_count"),
        exact_sum(F.col("clv_estimate"), 2).alias("total_clv"),
        exact_mean(F.col("clv_estimate"), 2).alias("mean_clv"),
        exact_sum(F.col("total_spend"), 2).alias("total_spend"),
        F.median("total_orders").alias("median_orders"),
        F.median("recency_days").alias("median_recency"),
        F.coalesce(F.mode("primary_seller_state", True), F.lit(NO_SELLER_STATE)).alias("top_seller_state"),
        round_even(per_cent(F.count_if(local), F.count(F.lit(1))), 1).alias("local_seller_pct"),
    )
    medians = quantiles(
        located, ["customer_state"], [Quantile("median_clv", "clv_estimate")], fixed_groups=False
    )
    rounded = sums.join(medians, "customer_state").select(
        "customer_state", "customer_count", _two("total_clv"), _two("median_clv"),
        _two("mean_clv"), _two("total_spend"), _two("median_orders"), _two("median_recency"),
        "top_seller_state", "local_seller_pct",
    )
    whole = located.agg(exact_sum(F.col("clv_estimate"), 2)).scalar()
    share = round_even(per_cent(F.col("total_clv"), whole), 1)
    return rounded.withColumn("clv_share_pct", share).orderBy(
        F.desc("total_clv"), "customer_state"
    )


def dashboard_fields(summary: DataFrame, comparison: DataFrame) -> DataFrame:
    """Calculated dashboard fields: value per customer and revenue uplift."""
    now, then = F.col("current_revenue_impact"), F.col("proposed_revenue_impact")
    return summary.join(comparison, "rfm_segment").select(
        "rfm_segment",
        round_even(F.try_divide(F.col("total_clv"), F.col("customer_count")), 4).alias("clv_per_customer"),
        round_even(F.try_divide(then - now, now), 4).alias("revenue_uplift"),
    )


def segment_overview(scores: DataFrame) -> DataFrame:
    """Bubble chart: median recency, median value and size per segment."""
    sizes = scores.groupBy("rfm_segment").agg(
        F.count(F.lit(1)).alias("customers"), F.median("recency_days").alias("median_recency")
    )
    values = quantiles(scores, ["rfm_segment"], [Quantile("median_clv", "clv_estimate")])
    return per_segment(sizes, values).select(
        "rfm_segment",
        "median_recency",
        _two("median_clv"),
        F.coalesce("customers", F.lit(0)).alias("customers"),
    )


def clv_box_stats(scores: DataFrame) -> DataFrame:
    """Box plot of positive values per segment: quartiles, whiskers, outliers."""
    positive = scores.filter(F.col("clv_estimate") > 0).select("rfm_segment", "clv_estimate")
    quartiles = quantiles(positive, ["rfm_segment"], [
        Quantile("q1", "clv_estimate", 0.25),
        Quantile("median", "clv_estimate"),
        Quantile("q3", "clv_estimate", 0.75),
    ])
    reach = (F.col("q3") - F.col("q1")) * 1.5
    value = F.col("clv_estimate")
    inside = value.between(F.col("low"), F.col("high"))
    fences = quartiles.select(
        "*", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high")
    )
    whiskers = positive.join(F.broadcast(fences), "rfm_segment").groupBy("rfm_segment").agg(
        F.count(F.lit(1)).alias("customers"),
        # A whisker ends at the last value inside the fence, never inside the box.
        F.least(F.min(F.when(inside, value)), F.max("q1")).alias("whisker_low"),
        F.greatest(F.max(F.when(inside, value)), F.max("q3")).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )
    return per_segment(quartiles, whiskers).select(
        "rfm_segment",
        F.coalesce("customers", F.lit(0)).alias("customers"),
        _two("whisker_low"),
        _two("q1"),
        _two("median"),
        _two("q3"),
        _two("whisker_high"),
        F.coalesce("outliers", F.lit(0)).alias("outliers"),
    )


def rf_crosstab(rfm: DataFrame) -> DataFrame:
    """Persons per recency and frequency score: all 25 cells, with log10 shades."""
    counts = rfm.groupBy("R_score", "F_score").agg(F.count(F.lit(1)).alias("n"))
    rows = small_table(rfm.sparkSession, [(s,) for s in range(5, 0, -1)], "R_score int")
    cells = [
        F.coalesce(F.max(F.when(F.col("F_score") == f, F.col("n"))), F.lit(0)).alias(f"f{f}")
        for f in range(1, 6)
    ]
    table = rows.join(counts, "R_score", "left").groupBy("R_score").agg(*cells)
    shades = [
        round_even(F.log10(F.nullif(F.col(f"f{f}"), F.lit(0))), 6).alias(f"log10_f{f}")
        for f in range(1, 6)
    ]
    return table.select("*", *shades)


def retention_chart(comparison: DataFrame) -> DataFrame:
    """Bars of both plans, in thousands."""
    columns = (
        "current_budget_allocation", "proposed_budget_allocation",
        "current_revenue_impact", "proposed_revenue_impact",
    )
    return comparison.select(
        "rfm_segment", *[round_even(F.col(c) / 1000, 4).alias(f"{c}_k") for c in columns]
    )


def state_values(scores: DataFrame) -> DataFrame:
    return (
        scores.filter(F.col("customer_state").isNotNull())
        .groupBy("customer_state")
        .agg(
            exact_sum(F.col("clv_estimate"), 2).alias("total_clv"),
            F.count(F.lit(1)).alias("customer_count"),
        )
    )


def _top_states(values: DataFrame, count: int) -> DataFrame:
    return values.orderBy(F.desc("total_clv"), "customer_state").limit(count)


def top_states_by_clv(scores: DataFrame, count: int = 10) -> DataFrame:
    """States with the most value, with size and median."""
    top = _top_states(state_values(scores), count)
    # Only customers of those few states take part in the medians.
    inside = scores.join(F.broadcast(top.select("customer_state")), "customer_state")
    medians = quantiles(inside, ["customer_state"], [Quantile("median_clv", "clv_estimate")])
    return top.join(F.broadcast(medians), "customer_state").select(
        "customer_state", "total_clv", "customer_count", _two("median_clv")
    )


def top3_state_share(scores: DataFrame) -> DataFrame:
    """Share of the three most valuable states in all value."""
    values = state_values(scores)
    top = _top_states(values, 3).agg(exact_sum(F.col("total_clv"), 2).alias("top3_clv"))
    whole = scores.agg(exact_sum(F.col("clv_estimate"), 2)).scalar()
    return top.withColumn("portfolio_clv", whole).withColumn(
        "top3_share_pct", round_even(per_cent(F.col("top3_clv"), F.col("portfolio_clv")), 1)
    )


# Exports that stay small (a fixed number of segments or scenarios, or one row
# per state) are published as a single file.
SINGLE_FILE = {
    "02_segment_summary", "03_retention_comparison", "04_clv_sensitivity", "05_geographic_summary",
}


def write_exports(exports: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """Write the flat CSV tables; the customer detail keeps its partitions."""
    written = {}
    for name, df in exports.items():
        out = df.coalesce(1) if name in SINGLE_FILE else df
        written[name] = f"{folder.rstrip('/')}/{name}"
        out.write.mode("overwrite").option("header", True).csv(written[name])
    return written
