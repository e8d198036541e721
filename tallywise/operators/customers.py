"""From delivered orders to one row per person."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Columns of the customer base in published order.
BASE_COLUMNS = (
    "customer_unique_id",
    "customer_state",
    "first_purchase_date",
    "last_purchase_date",
    "total_orders",
    "total_spend",
    "avg_order_value",
    "avg_review_score",
    "primary_category",
    "primary_seller_state",
    "recency_days",
    "customer_tenure_days",
)


def days_between(earlier: str, later: str) -> F.Column:
    """Whole elapsed days, part days cut off (not calendar-date differences).

    The interval form needs no session time zone, unlike ``timestamp_diff``.
    """
    return F.extract(F.lit("DAY"), F.col(later) - F.col(earlier)).cast("int")


def customer_rollup(orders: DataFrame) -> DataFrame:
    """One row per person from one aggregation.

    Replaces three windows and three self-joins. Tasks combine their rows before
    the shuffle and a person's state is a few distinct names, so a person with a
    large part of all orders sends one row per task.
    """
    latest = F.struct("order_purchase_timestamp", "order_id")
    money = F.sum("total_payment_value").cast("double")
    return (
        orders.groupBy("customer_unique_id")
        .agg(
            F.max_by("customer_state", latest).alias("customer_state"),
            F.min("order_purchase_timestamp").alias("first_purchase_date"),
            F.max("order_purchase_timestamp").alias("last_purchase_date"),
            F.count_distinct("order_id").alias("total_orders"),
            money.alias("total_spend"),
            (money / F.count(F.lit(1))).alias("avg_order_value"),
            F.try_divide(
                F.sum("review_score").cast("double"), F.count("review_score")
            ).alias("avg_review_score"),
            F.mode("primary_category", True).alias("primary_category"),
            F.mode("seller_state", True).alias("primary_seller_state"),
        )
        .withColumn(
            "customer_tenure_days", days_between("first_purchase_date", "last_purchase_date")
        )
    )


def reference_date(rollup: DataFrame) -> DataFrame:
    """Latest purchase among the persons: the analysis' "today", as one row."""
    return rollup.agg(F.max("last_purchase_date").alias("reference_date"))


def customer_base(rollup: DataFrame) -> DataFrame:
    """Add recency relative to the reference date, a scalar subquery."""
    return (
        rollup.withColumn("reference_date", reference_date(rollup).scalar())
        .withColumn("recency_days", days_between("last_purchase_date", "reference_date"))
        .select(*BASE_COLUMNS)
    )
