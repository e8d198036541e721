"""Diagnostics of the customer tables: completeness, ranges and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.order_stats import Quantile, quantiles
from ..functions.values import currency, exact_mean, per_cent, round_even
from .scoring import SCORES
from .segments import per_segment

NUMERIC = (
    "total_orders",
    "total_spend",
    "avg_order_value",
    "recency_days",
    "customer_tenure_days",
    "avg_review_score",
)
NULL_FLAG_PCT = 5
HISTOGRAM_VALUES = 10


def _two(value: Column) -> Column:
    return round_even(value.cast("double"), 2)


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls per column, in number and percent, flagged above 5 %."""
    counts = df.agg(
        F.count(F.lit(1)).alias("rows_"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns],
    )
    tall = counts.select(
        "rows_",
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count"))
            for c in df.columns
        ])),
    )
    pct = per_cent(F.col("null_count"), F.col("rows_"))
    return tall.select(
        "column_name",
        "null_count",
        round_even(pct, 1).alias("null_pct"),
        F.coalesce(pct > NULL_FLAG_PCT, F.lit(False)).alias("flagged"),
    )


def numeric_profile(df: DataFrame, columns: tuple[str, ...] = NUMERIC) -> DataFrame:
    """Minimum, median, maximum and mean per numeric column, one row each."""
    tall = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value"))
        for c in columns
    ])))
    value = F.col("value")
    spread = tall.groupBy("column_name").agg(
        _two(F.min(value)).alias("min_value"),
        _two(F.max(value)).alias("max_value"),
        _two(exact_mean(value, 10)).alias("mean_value"),
    )
    medians = quantiles(tall, ["column_name"], [Quantile("median_value", "value")])
    return spread.join(F.broadcast(medians), "column_name", "left").select(
        "column_name",
        "min_value",
        _two(F.col("median_value")).alias("median_value"),
        "max_value",
        "mean_value",
    )


def quality_flags(scores: DataFrame) -> DataFrame:
    """Counts of suspicious rows, in one pass over the scored customers."""
    clv = F.col("clv_estimate")
    return scores.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("total_spend") == 0).alias("zero_spend"),
        F.count_if(F.col("recency_days") < 0).alias("negative_recency"),
        F.count_distinct("rfm_segment").alias("distinct_segments"),
        F.count_if(F.col("rfm_segment").isNull()).alias("null_segments"),
        F.count_if(clv.isNull()).alias("clv_nulls"),
        F.count_if(clv == 0).alias("clv_zeros"),
        F.count_if(clv < 0).alias("clv_negatives"),
    )


def repeat_rate(base: DataFrame) -> DataFrame:
    """Share of persons who bought more than once."""
    repeat = F.count_if(F.col("total_orders") > 1)
    return base.agg(
        F.count(F.lit(1)).alias("customers"),
        repeat.alias("repeat_customers"),
        round_even(per_cent(repeat, F.count(F.lit(1))), 1).alias("repeat_pct"),
    )


def frequency_histogram(base: DataFrame, shown: int = HISTOGRAM_VALUES) -> DataFrame:
    """Persons per order count: the first ten counts, then one "n+" row.

    The window runs over distinct order counts, of which N orders can make
    sqrt(2 N) at most.
    """
    counts = base.groupBy("total_orders").agg(F.count(F.lit(1)).alias("customers"))
    placed = counts.withColumn(
        "place", F.row_number().over(Window.partitionBy().orderBy("total_orders"))
    )
    folded = placed.groupBy(F.least("place", F.lit(shown + 1)).alias("place")).agg(
        F.min("total_orders").alias("orders"), F.sum("customers").alias("customers")
    )
    everyone = base.agg(F.count(F.lit(1))).scalar()
    number = F.col("orders").cast("string")
    return folded.select(
        F.when(F.col("place") > shown, F.concat(number, F.lit("+"))).otherwise(number).alias("orders"),
        "customers",
        round_even(per_cent(F.col("customers"), everyone), 1).alias("customer_pct"),
    )


def top_states_by_customers(base: DataFrame, count: int = 5) -> DataFrame:
    everyone = base.agg(F.count(F.lit(1))).scalar()
    top = (
        base.filter(F.col("customer_state").isNotNull())
        .groupBy("customer_state")
        .agg(F.count(F.lit(1)).alias("customers"))
        .orderBy(F.desc("customers"), "customer_state")
        .limit(count)
    )
    return top.select(
        "customer_state",
        "customers",
        round_even(per_cent(F.col("customers"), everyone), 1).alias("customer_pct"),
    )


def top_spenders(base: DataFrame, count: int = 5) -> DataFrame:
    return base.orderBy(F.desc("total_spend"), "customer_unique_id").limit(count)


def base_overview(base: DataFrame) -> DataFrame:
    """One-time and repeat buyers, median spend and median recency."""
    single, repeat = (F.count_if(c) for c in (F.col("total_orders") == 1, F.col("total_orders") > 1))
    everyone = F.count(F.lit(1))
    counts = base.agg(
        everyone.alias("customers"),
        single.alias("single_customers"),
        round_even(per_cent(single, everyone), 1).alias("single_pct"),
        repeat.alias("multi_customers"),
        round_even(per_cent(repeat, everyone), 1).alias("multi_pct"),
        F.median("recency_days").alias("median_recency"),
    )
    spend = quantiles(base, [], [Quantile("median_spend", "total_spend")]).scalar()
    return counts.withColumn("median_spend", _two(spend))


def composite_stats(rfm: DataFrame) -> DataFrame:
    """Range and centre of the composite score (81 to 401 possible values)."""
    c = F.col("rfm_composite")
    return rfm.agg(
        F.min(c).alias("min_composite"),
        F.max(c).alias("max_composite"),
        _two(F.median(c)).alias("median_composite"),
        _two(exact_mean(c, 2)).alias("mean_composite"),
    )


def rfm_segment_breakdown(rfm: DataFrame) -> DataFrame:
    """Size, share and seven medians per segment; empty segments keep a row."""
    # Scores, days and counts have few distinct values; spend goes the narrowing way.
    few = {
        "median_r": "R_score",
        "median_f": "F_score",
        "median_m": "M_score",
        "median_composite": "rfm_composite",
        "median_recency": "recency_days",
        "median_orders": "total_orders",
    }
    sizes = rfm.groupBy("rfm_segment").agg(
        F.count(F.lit(1)).alias("customers"),
        *[F.median(c).alias(name) for name, c in few.items()],
    )
    spend = quantiles(rfm, ["rfm_segment"], [Quantile("median_spend", "total_spend")])
    everyone = F.sum("customers").over(Window.partitionBy())
    return per_segment(sizes, spend).select(
        "rfm_segment",
        "segment_sort_order",
        F.coalesce("customers", F.lit(0)).alias("customers"),
        round_even(
            F.coalesce(per_cent(F.col("customers"), everyone), F.lit(0.0)), 1
        ).alias("customer_pct"),
        *[_two(F.col(c)).alias(c) for c in few],
        _two(F.col("median_spend")).alias("median_spend"),
    )


def score_distribution(rfm: DataFrame) -> DataFrame:
    """Persons per score of each dimension, with a text bar of one mark per 2 %."""
    labels = dict(zip(SCORES, ("Recency", "Frequency", "Monetary"), strict=True))
    tall = rfm.select(F.inline(F.array(*[
        F.struct(F.lit(label).alias("dimension"), F.col(c).alias("score"))
        for c, label in labels.items()
    ])))
    counts = tall.groupBy("dimension", "score").agg(F.count(F.lit(1)).alias("customers"))
    # At most fifteen rows.
    pct = per_cent(F.col("customers"), F.sum("customers").over(Window.partitionBy("dimension")))
    return counts.select(
        "dimension",
        "score",
        "customers",
        round_even(pct, 1).alias("customer_pct"),
        F.repeat(F.lit("█"), (pct / 2).cast("int")).alias("bar"),
    )


def formatted_segment_table(rfm: DataFrame) -> DataFrame:
    """Segment sizes and medians as display text."""
    return rfm_segment_breakdown(rfm).select(
        "rfm_segment",
        F.format_number("customers", 0).alias("customers"),
        F.concat(F.format_number("customer_pct", 1), F.lit("%")).alias("pct"),
        currency(F.col("median_spend")).alias("median_spend"),
        F.concat(F.format_number("median_recency", 0), F.lit(" days")).alias("median_recency"),
    )
