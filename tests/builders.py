"""Small hand-made customer tables."""

from __future__ import annotations

from datetime import datetime, timedelta

BASE_SCHEMA = """
    customer_unique_id string, customer_state string, first_purchase_date timestamp_ntz,
    last_purchase_date timestamp_ntz, total_orders long, total_spend double,
    avg_order_value double, avg_review_score double, primary_category string,
    primary_seller_state string, recency_days int, customer_tenure_days int
"""
TODAY = datetime(2018, 8, 29)


def person(name, orders=1, spend=100.0, recency=10, tenure=0, state="SP", seller="SP", review=5.0):
    last = TODAY - timedelta(days=recency)
    return (
        name, state, last - timedelta(days=tenure), last, orders, float(spend),
        float(spend) / orders, review, "perfumery", seller, recency, tenure,
    )


def base_table(spark, people):
    return spark.createDataFrame(people, BASE_SCHEMA)


def segmented(spark, rows):
    """Persons with given segment and scores: (person tuple, segment, R, F, M)."""
    schema = BASE_SCHEMA + (
        ", R_score int, F_score int, M_score int, rfm_composite double, rfm_segment string"
    )
    data = [
        (*p, r, f, m, (40 * r + 35 * f + 25 * m) / 100, segment) for p, segment, r, f, m in rows
    ]
    return spark.createDataFrame(data, schema)


def as_dict(df, key, *values):
    rows = df.collect()
    if len(values) == 1:
        return {r[key]: r[values[0]] for r in rows}
    return {r[key]: tuple(r[v] for v in values) for r in rows}
