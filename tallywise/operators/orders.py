"""From the raw tables to one row per delivered order."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

UNKNOWN = "unknown"


def filtered_orders(orders: DataFrame) -> DataFrame:
    """Delivered orders with a known delivery date."""
    delivered = (F.col("order_status") == "delivered") & F.col(
        "order_delivered_customer_date"
    ).isNotNull()
    return orders.filter(delivered).select(
        "order_id", "customer_id", "order_purchase_timestamp", "order_delivered_customer_date"
    )


def identity_resolution(delivered: DataFrame, customers: DataFrame) -> DataFrame:
    """Attach the person behind each order's customer record."""
    return delivered.join(customers, "customer_id").select(
        "order_id",
        "customer_id",
        "customer_unique_id",
        "customer_state",
        "order_purchase_timestamp",
    )


def payments_by_order(payments: DataFrame) -> DataFrame:
    """Payments hold one row per installment: add them up before any join."""
    return payments.groupBy("order_id").agg(
        F.sum("payment_value").alias("total_payment_value"),
        F.count(F.lit(1)).alias("num_installments"),
    )


def product_categories(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Product to category: translated name, else own name, else unknown."""
    return products.join(translation, "product_category_name", "left").select(
        "product_id",
        F.coalesce(
            "product_category_name_english", "product_category_name", F.lit(UNKNOWN)
        ).alias("category"),
    )


def categorised_items(
    items: DataFrame, products: DataFrame, translation: DataFrame
) -> DataFrame:
    """Items with their category; the dimension is resolved before the big join."""
    categories = product_categories(products, translation)
    return items.join(categories, "product_id", "left").withColumn(
        "category", F.coalesce("category", F.lit(UNKNOWN))
    )


def order_item_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("order_id").agg(F.count(F.lit(1)).alias("item_count"))


def order_modal_category(categorised: DataFrame) -> DataFrame:
    """Commonest category per order, the smallest name on a tie."""
    return categorised.groupBy("order_id").agg(
        F.mode("category", True).alias("primary_category")
    )


def order_modal_seller(items: DataFrame, sellers: DataFrame) -> DataFrame:
    """Commonest known seller state per order; orders without one drop out."""
    known = sellers.filter(F.col("seller_state").isNotNull())
    return items.join(known, "seller_id").groupBy("order_id").agg(
        F.mode("seller_state", True).alias("seller_state")
    )


def items_by_order(
    items: DataFrame, products: DataFrame, translation: DataFrame, sellers: DataFrame
) -> DataFrame:
    """Item count, commonest category and commonest known seller state per order.

    One pass and one shuffle over the items. Each task combines its rows first,
    and a group's state is its distinct categories and states, so an order with
    very many items stays cheap. Ties go to the smallest name.
    """
    return (
        categorised_items(items, products, translation)
        .join(sellers, "seller_id", "left")
        .groupBy("order_id")
        .agg(
            F.count(F.lit(1)).alias("item_count"),
            F.mode("category", True).alias("primary_category"),
            F.mode("seller_state", True).alias("seller_state"),
        )
    )


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """Score of the most recently answered review; unanswered ones come last."""
    newest_first = F.struct("review_answer_timestamp", "review_score")
    return reviews.groupBy("order_id").agg(
        F.max_by("review_score", newest_first).alias("review_score")
    )


def customer_orders(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per delivered order with person, money, category and review."""
    orders = identity_resolution(
        filtered_orders(tables["orders"]), tables["customers"]
    ).drop("customer_id")
    items = items_by_order(
        tables["order_items"],
        tables["products"],
        tables["category_translation"],
        tables["sellers"],
    )
    return (
        orders.join(payments_by_order(tables["order_payments"]), "order_id", "left")
        .join(items, "order_id", "left")
        .join(latest_reviews(tables["order_reviews"]), "order_id", "left")
        .select(
            "customer_unique_id",
            "customer_state",
            "order_id",
            "order_purchase_timestamp",
            F.coalesce("total_payment_value", F.lit(0).cast("decimal(28,2)")).alias(
                "total_payment_value"
            ),
            F.coalesce("num_installments", F.lit(1)).alias("num_installments"),
            F.coalesce("item_count", F.lit(0)).alias("item_count"),
            F.coalesce("primary_category", F.lit(UNKNOWN)).alias("primary_category"),
            "seller_state",
            "review_score",
        )
    )
