"""The eight input tables, derived from the order/lineitem benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.values import small_table

MONEY = "decimal(18,2)"

# Category labels with a translation ('STANDARD' has none).
TRANSLATIONS = (
    ("ECONOMY", "budget"),
    ("LARGE", "oversize"),
    ("SMALL", "compact"),
    ("MEDIUM", "regular"),
)

# Labels that stand for "not known".
UNKNOWN_CATEGORY = "PROMO"
UNKNOWN_SELLER_STATE = "NATION_0"
STATE_COUNT = 25

BASE_TABLES = ("orders", "lineitem", "customer", "nation", "part", "supplier")


def load_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Map the parquet tables under ``sf_dir`` onto the input schemas."""

    def scan(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

    orders, lines, nation = scan("orders"), scan("lineitem"), scan("nation")

    delivery = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_shipdate").alias("order_delivered_customer_date")
    )
    status = (
        F.when(F.col("o_orderstatus") == "F", "delivered")
        .when(F.col("o_orderstatus") == "O", "shipped")
        .otherwise("canceled")
    )
    price = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    # One order in seven ships to the next state over, so persons do move.
    moved = F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)

    return {
        "orders": orders.join(delivery, "o_orderkey", "left").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_orderkey").alias("customer_id"),
            status.alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
            "order_delivered_customer_date",
        ),
        "order_items": lines.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
        ),
        "order_payments": lines.select(
            F.col("l_orderkey").alias("order_id"),
            (F.floor(price * 100 + 0.5) / 100).cast(MONEY).alias("payment_value"),
        ),
        "customers": orders.join(
            scan("customer"), F.col("o_custkey") == F.col("c_custkey")
        )
        .withColumn("n_nationkey", (F.col("c_nationkey") + moved) % STATE_COUNT)
        .join(nation, "n_nationkey")
        .select(
            F.col("o_orderkey").alias("customer_id"),
            F.col("c_custkey").alias("customer_unique_id"),
            F.col("n_name").alias("customer_state"),
        ),
        "products": scan("part").select(
            F.col("p_partkey").alias("product_id"),
            F.nullif("p_type", F.lit(UNKNOWN_CATEGORY)).alias("product_category_name"),
        ),
        "order_reviews": lines.filter(F.col("l_returnflag") == "R").select(
            F.col("l_orderkey").alias("order_id"),
            (1 + F.col("l_partkey") % 5).cast("int").alias("review_score"),
            F.col("l_shipdate").alias("review_answer_timestamp"),
        ),
        "sellers": scan("supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("seller_id"),
            F.nullif("n_name", F.lit(UNKNOWN_SELLER_STATE)).alias("seller_state"),
        ),
        "category_translation": small_table(
            spark, TRANSLATIONS, "product_category_name string, product_category_name_english string"
        ),
    }
