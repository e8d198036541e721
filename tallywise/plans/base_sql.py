"""The customer base as one SQL query over the eight input tables."""

from __future__ import annotations

# Written for ``sources.catalog.run_sql``, which binds the table names.
CUSTOMER_BASE = """
WITH labels AS (
  SELECT product_id, coalesce(product_category_name_english, product_category_name, 'unknown') AS category
  FROM products LEFT JOIN category_translation USING (product_category_name)
), lines AS (
  SELECT order_id, count(*) AS item_count,
         mode(coalesce(category, 'unknown'), true) AS primary_category,
         mode(seller_state, true) AS seller_state
  FROM order_items LEFT JOIN labels USING (product_id) LEFT JOIN sellers USING (seller_id)
  GROUP BY order_id
), paid AS (
  SELECT order_id, sum(payment_value) AS paid FROM order_payments GROUP BY order_id
), judged AS (
  SELECT order_id, max_by(review_score, struct(review_answer_timestamp, review_score)) AS review_score
  FROM order_reviews GROUP BY order_id
), bought AS (
  SELECT customer_unique_id, customer_state, order_id, order_purchase_timestamp AS bought_at,
         coalesce(paid, 0) AS paid, coalesce(primary_category, 'unknown') AS primary_category,
         seller_state, review_score
  FROM orders JOIN customers USING (customer_id)
  LEFT JOIN paid USING (order_id) LEFT JOIN lines USING (order_id) LEFT JOIN judged USING (order_id)
  WHERE order_status = 'delivered' AND order_delivered_customer_date IS NOT NULL
), persons AS (
  SELECT customer_unique_id,
         max_by(customer_state, struct(bought_at, order_id)) AS customer_state,
         min(bought_at) AS first_purchase_date, max(bought_at) AS last_purchase_date,
         count(DISTINCT order_id) AS total_orders,
         CAST(sum(paid) AS DOUBLE) AS total_spend, CAST(sum(paid) AS DOUBLE) / count(*) AS avg_order_value,
         try_divide(CAST(sum(review_score) AS DOUBLE), count(review_score)) AS avg_review_score,
         mode(primary_category, true) AS primary_category,
         mode(seller_state, true) AS primary_seller_state
  FROM bought GROUP BY customer_unique_id
)
SELECT persons.*,
       CAST(extract(DAY FROM (SELECT max(last_purchase_date) FROM persons) - last_purchase_date) AS INT) AS recency_days,
       CAST(extract(DAY FROM last_purchase_date - first_purchase_date) AS INT) AS customer_tenure_days
FROM persons ORDER BY total_spend DESC, customer_unique_id
"""
