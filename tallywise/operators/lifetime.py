"""Yearly order rate, lifespan and customer lifetime value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.order_stats import Quantile, quantiles
from ..functions.values import cap_at, currency, exact_mean, exact_sum, floor_at, per_cent, round_even
from ..params import (
    DAYS_PER_YEAR,
    GROSS_MARGIN,
    MAX_YEARLY_ORDERS,
    MIN_EMPIRICAL_YEARS,
    MIN_MODEL_YEARS,
    HORIZON_YEARS,
    MODEL_YEARS_UNKNOWN,
    NO_REPEAT_YEARS,
    SAME_DAY_YEARLY_ORDERS,
    SENSITIVITY_MARGINS,
)
from ..sources.catalog import require_columns
from .segments import per_segment, segment_dimension

REQUIRED = (
    "customer_unique_id",
    "total_orders",
    "total_spend",
    "avg_order_value",
    "recency_days",
    "customer_tenure_days",
    "rfm_segment",
)
EMPIRICAL, MODEL = "empirical", "BG/NBD"
PORTFOLIO = "All segments"


def repeat_buyer() -> Column:
    return F.col("total_orders") > 1


def annualized_frequency() -> Column:
    """Orders per year: observed for repeat buyers, assumed by recency for others."""
    orders, tenure, recency = (
        F.col(c) for c in ("total_orders", "customer_tenure_days", "R_score")
    )
    observed = F.try_divide(orders.cast("double"), tenure) * F.lit(DAYS_PER_YEAR)
    assumed = F.when(recency >= 4, 2.0).when(recency == 3, 1.5).otherwise(1.0)
    return (
        F.when((orders > 1) & (tenure > 0), cap_at(observed, MAX_YEARLY_ORDERS))
        .when((orders > 1) & (tenure == 0), F.lit(SAME_DAY_YEARLY_ORDERS))
        .when(orders == 1, assumed)
        .otherwise(1.0)
    )


def segment_years(rfm: DataFrame) -> DataFrame:
    """Years assumed for a segment's one-time buyers: median repeat-buyer tenure.

    Segments without repeat buyers take the median of all of them; the default
    stands when nobody ever came back. Tenures are whole days, so a median's
    state is at most the number of days the data span.
    """
    tenure = F.median(F.when(repeat_buyer(), F.col("customer_tenure_days")))
    by_segment = rfm.groupBy("rfm_segment").agg(tenure.alias("own"))
    known = F.coalesce(F.col("own"), rfm.agg(tenure).scalar()) / DAYS_PER_YEAR
    return (
        segment_dimension(rfm.sparkSession)
        .join(by_segment, "rfm_segment", "left")
        .select(
            "rfm_segment",
            F.coalesce(floor_at(known, MIN_EMPIRICAL_YEARS), F.lit(NO_REPEAT_YEARS)).alias(
                "segment_years"
            ),
        )
    )


def empirical_lifespan(rfm: DataFrame) -> DataFrame:
    """Add ``lifespan_years``: own tenure for repeat buyers, else the segment's."""
    own = F.greatest(F.col("customer_tenure_days") / DAYS_PER_YEAR, F.lit(MIN_EMPIRICAL_YEARS))
    return (
        rfm.join(F.broadcast(segment_years(rfm)), "rfm_segment", "left")
        .withColumn("lifespan_years", F.when(repeat_buyer(), own).otherwise(F.col("segment_years")))
        .drop("segment_years")
    )


def model_lifespan(with_alive: DataFrame) -> DataFrame:
    """Add ``lifespan_years`` from ``prob_alive``: share of the horizon still to come.

    Persons the model cannot judge take their segment's median.
    """
    years = floor_at(F.col("prob_alive") * HORIZON_YEARS, MIN_MODEL_YEARS)
    known = with_alive.withColumn("model_years", years)
    middle = quantiles(known, ["rfm_segment"], [Quantile("segment_years", "model_years")])
    return (
        known.join(F.broadcast(middle), "rfm_segment", "left")
        .withColumn(
            "lifespan_years",
            F.coalesce("model_years", "segment_years", F.lit(MODEL_YEARS_UNKNOWN)),
        )
        .drop("model_years", "segment_years")
    )


def clv(margin: Column) -> Column:
    """Order value x orders per year x margin x years, never negative, in cents."""
    value = F.col("avg_order_value") * F.col("yearly_orders") * margin * F.col("lifespan_years")
    return round_even(floor_at(value, 0.0), 2)


def value_inputs(rfm: DataFrame, with_lifespan: DataFrame | None = None) -> DataFrame:
    """Segmented persons with unrounded ``yearly_orders`` and ``lifespan_years``.

    ``with_lifespan`` carries a model lifespan and ``prob_alive``; without it the
    lifespan is empirical and ``prob_alive`` unknown.
    """
    require_columns(rfm, REQUIRED, "segmented customers")
    if with_lifespan is None:
        frame = empirical_lifespan(rfm).withColumn("prob_alive", F.lit(None).cast("double"))
        method = EMPIRICAL
    else:
        frame, method = with_lifespan, MODEL
    return frame.withColumn("yearly_orders", annualized_frequency()).withColumn(
        "lifespan_method", F.lit(method)
    ).select(*rfm.columns, "yearly_orders", "lifespan_years", "prob_alive", "lifespan_method")


def chosen_inputs(empirical: DataFrame, modelled: DataFrame, use_model: Column) -> DataFrame:
    """Value inputs of one of two methods; ``use_model`` is a scalar of the plan.

    Both are filtered by the same scalar, so the one not wanted reads no row.
    """
    return modelled.filter(F.coalesce(use_model, F.lit(False))).unionByName(
        empirical.filter(~F.coalesce(use_model, F.lit(False)))
    )


def clv_scores(inputs: DataFrame, margin: float = GROSS_MARGIN) -> DataFrame:
    """Published scores: value in cents, rate, years and P(alive) to four places."""
    passed = [
        c for c in inputs.columns
        if c not in ("yearly_orders", "lifespan_years", "prob_alive", "lifespan_method")
    ]
    return inputs.select(
        *passed,
        clv(F.lit(margin)).alias("clv_estimate"),
        round_even(F.col("yearly_orders"), 4).alias("annualized_frequency"),
        round_even(F.col("lifespan_years"), 4).alias("estimated_lifespan_years"),
        round_even(F.col("prob_alive"), 4).alias("prob_alive"),
        "lifespan_method",
    )


def clv_sensitivity(
    inputs: DataFrame, margins: Sequence[float] = SENSITIVITY_MARGINS
) -> DataFrame:
    """Median and total value per segment and margin, all margins in one pass."""
    scenarios = F.array(*[
        F.struct(F.lit(m).alias("gross_margin_assumption"), clv(F.lit(m)).alias("value"))
        for m in margins
    ])
    values = inputs.select("rfm_segment", F.inline(scenarios))
    keys = ["rfm_segment", "gross_margin_assumption"]
    totals = values.groupBy(*keys).agg(exact_sum(F.col("value"), 2).alias("total_clv"))
    medians = quantiles(values, keys, [Quantile("median_clv", "value")])
    return medians.join(totals, keys).select(*keys, "median_clv", "total_clv")


def clv_sensitivity_pivot(
    sensitivity: DataFrame, margins: Sequence[float] = SENSITIVITY_MARGINS
) -> DataFrame:
    """Segments down, margins across."""
    margin = F.col("gross_margin_assumption")
    return sensitivity.groupBy("rfm_segment").agg(*[
        F.max(F.when(margin == m, F.col("median_clv"))).alias(f"margin_{round(m * 100)}")
        for m in margins
    ])


def clv_summary(scores: DataFrame) -> DataFrame:
    """Value per segment and for the portfolio as a whole."""
    levels = F.explode(F.array("rfm_segment", F.lit(PORTFOLIO))).alias("rfm_segment")
    both = scores.select(levels, "clv_estimate")
    value = F.col("clv_estimate")
    sums = both.groupBy("rfm_segment").agg(
        F.count(F.lit(1)).alias("customers"),
        exact_mean(value, 2).alias("mean_clv"),
        exact_sum(value, 2).alias("total_clv"),
    )
    medians = quantiles(both, ["rfm_segment"], [Quantile("median_clv", "clv_estimate")])
    whole = scores.agg(exact_sum(value, 2)).scalar()
    return per_segment(sums, medians, extra=(PORTFOLIO,)).select(
        "rfm_segment",
        F.coalesce("customers", F.lit(0)).alias("customers"),
        round_even(F.col("median_clv"), 2).alias("median_clv"),
        round_even(F.col("mean_clv"), 2).alias("mean_clv"),
        round_even(F.col("total_clv"), 2).alias("total_clv"),
        round_even(per_cent(F.col("total_clv"), whole), 1).alias("clv_share_pct"),
    )


def formatted_clv_table(scores: DataFrame) -> DataFrame:
    """Value per segment as display text."""
    return clv_summary(scores).select(
        "rfm_segment",
        F.format_number("customers", 0).alias("customers"),
        *[currency(F.col(c)).alias(c) for c in ("median_clv", "mean_clv", "total_clv")],
        F.concat(F.format_number("clv_share_pct", 1), F.lit("%")).alias("clv_share"),
    )


def cohort_tenure(rfm: DataFrame) -> DataFrame:
    """Median tenure of repeat buyers by number of orders."""
    return (
        rfm.filter(repeat_buyer())
        .groupBy("total_orders")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.median("customer_tenure_days").alias("median_tenure_days"),
        )
        .withColumn("median_tenure_years", round_even(F.col("median_tenure_days") / DAYS_PER_YEAR, 4))
    )


def frequency_stats(inputs: DataFrame) -> DataFrame:
    """Yearly orders of repeat buyers (observed) and one-time buyers (assumed)."""
    kinds = inputs.select(
        F.when(repeat_buyer(), "repeat").otherwise("single").alias("buyers"), "yearly_orders"
    )
    rates = kinds.groupBy("buyers").agg(
        F.count(F.lit(1)).alias("customers"),
        round_even(exact_mean(F.col("yearly_orders"), 10), 4).alias("mean_frequency"),
    )
    medians = quantiles(kinds, ["buyers"], [Quantile("median_frequency", "yearly_orders")])
    return rates.join(F.broadcast(medians), "buyers").withColumn(
        "median_frequency", round_even(F.col("median_frequency"), 4)
    )


def imputed_frequency_by_recency(inputs: DataFrame) -> DataFrame:
    """Rate assumed for one-time buyers at each recency score."""
    return (
        inputs.filter(F.col("total_orders") == 1)
        .groupBy("R_score")
        .agg(
            F.max("yearly_orders").alias("imputed_frequency"),
            F.count(F.lit(1)).alias("customers"),
        )
    )


def lifespan_stats(inputs: DataFrame) -> DataFrame:
    """Median, mean and range of the lifespan in use, and the median P(alive)."""
    years = F.col("lifespan_years")
    spread = inputs.agg(
        round_even(exact_mean(years, 10), 4).alias("mean_years"),
        round_even(F.min(years), 4).alias("min_years"),
        round_even(F.max(years), 4).alias("max_years"),
        F.max("lifespan_method").alias("lifespan_method"),
    )
    middle = quantiles(
        inputs, [], [Quantile("median_years", "lifespan_years"), Quantile("median_alive", "prob_alive")]
    )
    return spread.crossJoin(F.broadcast(middle)).select(
        "lifespan_method",
        round_even(F.col("median_years"), 4).alias("median_years"),
        "mean_years",
        "min_years",
        "max_years",
        round_even(F.col("median_alive"), 4).alias("median_prob_alive"),
    )
