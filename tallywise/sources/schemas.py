"""Declared columns of the eight input tables.

Keys assumed unique: orders.order_id, customers.customer_id,
products.product_id, sellers.seller_id and
category_translation.product_category_name. ``customer_id`` names one order's
customer record; the person is ``customer_unique_id``.
"""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()
_TS = T.TimestampNTZType()
_MONEY = T.DecimalType(18, 2)

INPUT_SCHEMAS: dict[str, T.StructType] = {
    "orders": T.StructType([
        T.StructField("order_id", _S),
        T.StructField("customer_id", _S),
        T.StructField("order_status", _S),
        T.StructField("order_purchase_timestamp", _TS),
        T.StructField("order_delivered_customer_date", _TS),
    ]),
    "order_items": T.StructType([
        T.StructField("order_id", _S),
        T.StructField("product_id", _S),
        T.StructField("seller_id", _S),
    ]),
    "order_payments": T.StructType([
        T.StructField("order_id", _S),
        T.StructField("payment_value", _MONEY),
    ]),
    "customers": T.StructType([
        T.StructField("customer_id", _S),
        T.StructField("customer_unique_id", _S),
        T.StructField("customer_state", _S),
    ]),
    "products": T.StructType([
        T.StructField("product_id", _S),
        T.StructField("product_category_name", _S),
    ]),
    "order_reviews": T.StructType([
        T.StructField("order_id", _S),
        T.StructField("review_score", T.IntegerType()),
        T.StructField("review_answer_timestamp", _TS),
    ]),
    "sellers": T.StructType([
        T.StructField("seller_id", _S),
        T.StructField("seller_state", _S),
    ]),
    "category_translation": T.StructType([
        T.StructField("product_category_name", _S),
        T.StructField("product_category_name_english", _S),
    ]),
}

TABLES = tuple(INPUT_SCHEMAS)
