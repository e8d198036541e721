from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallywise.__main__ import main
from tallywise.operators.customers import BASE_COLUMNS, customer_base, customer_rollup
from tallywise.operators.orders import customer_orders, filtered_orders
from tallywise.sources.catalog import (
    MissingInput,
    read_csv_tables,
    read_parquet_tables,
    require_columns,
    run_sql,
    table_row_counts,
)
from tallywise.sources.publish import read_published

FILES = {
    # Columns in another order than declared, and one nobody asked for.
    "orders.csv": """order_id,order_status,customer_id,order_purchase_timestamp,order_delivered_customer_date,extra
o1,delivered,c1,2018-01-01 23:00:00,2018-01-09 10:00:00,x
o2,delivered,c2,2018-01-03 01:00:00,2018-01-10 10:00:00,x
o3,shipped,c3,2018-05-01 00:00:00,2018-05-02 00:00:00,x
o4,delivered,c4,2018-06-01 00:00:00,,x
o5,delivered,c5,2018-02-01 12:00:00,2018-02-03 12:00:00,x
o6,delivered,c6,2018-02-01 12:00:00,2018-02-03 12:00:00,x
""",
    "order_items.csv": """order_id,product_id,seller_id
o1,pb,s1
o1,pa,s2
o1,pa,s2
o1,pb,s1
o2,px,s3
o2,pn,s3
o2,pn,s3
o5,missing,s9
""",
    "order_payments.csv": """order_id,payment_value
o1,10.10
o1,20.20
o2,5.05
o5,0.00
""",
    "customers.csv": """customer_id,customer_unique_id,customer_state
c1,ann,SP
c2,ann,RJ
c3,bob,SP
c4,bob,SP
c5,cat,MG
c6,cat,BA
""",
    "products.csv": """product_id,product_category_name
pa,beta
pb,alfa
pn,
px,untranslated
""",
    "order_reviews.csv": '''order_id,review_score,review_answer_timestamp,review_comment
o1,1,2018-01-10 00:00:00,"two
lines, and a ""quote"""
o1,5,2018-01-12 00:00:00,later
o1,3,,never answered
o2,2,2018-01-12 00:00:00,tie
o2,4,2018-01-12 00:00:00,tie
''',
    "sellers.csv": """seller_id,seller_state
s1,SP
s2,PR
s3,
""",
    # Byte order mark, CRLF and no newline at the end.
    "category_translation.csv": "﻿product_category_name,product_category_name_english\r\n"
    "alfa,a_name\r\nbeta,b_name",
}


@pytest.fixture(scope="module")
def raw_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for name, text in FILES.items():
        (folder / name).write_bytes(text.encode())
    return folder


@pytest.fixture
def tables(spark, raw_dir):
    return read_csv_tables(spark, str(raw_dir))


def test_all_missing_files_are_named(spark, tmp_path):
    with pytest.raises(MissingInput, match="orders.csv.*sellers.csv"):
        read_csv_tables(spark, str(tmp_path))


def test_missing_columns_are_named(spark):
    with pytest.raises(MissingInput, match="b, c"):
        require_columns(spark.range(1).withColumnRenamed("id", "a"), ["a", "b", "c"])


def test_row_counts(tables):
    counts = {r["table_name"]: r["row_count"] for r in table_row_counts(tables).collect()}
    assert counts["order_reviews"] == 5 and counts["category_translation"] == 2
    assert counts["total"] == sum(v for k, v in counts.items() if k != "total")


def test_only_delivered_orders_with_a_date(tables):
    rows = filtered_orders(tables["orders"]).collect()
    assert sorted(r["order_id"] for r in rows) == ["o1", "o2", "o5", "o6"]


def test_order_details(tables):
    rows = {r["order_id"]: r for r in customer_orders(tables).collect()}
    first = rows["o1"]
    assert float(first["total_payment_value"]) == 30.30
    assert (first["num_installments"], first["item_count"]) == (2, 4)
    assert first["primary_category"] == "a_name"  # 2 : 2, smaller name
    assert first["seller_state"] == "PR"
    assert first["review_score"] == 5  # unanswered reviews come last
    second = rows["o2"]
    assert second["primary_category"] == "unknown"
    assert second["seller_state"] is None
    assert second["review_score"] == 4  # equal answer times: higher score
    assert rows["o5"]["primary_category"] == "unknown"
    bare = rows["o6"]
    assert (float(bare["total_payment_value"]), bare["num_installments"], bare["item_count"]) == (0.0, 1, 0)
    assert bare["review_score"] is None


def test_one_row_per_person(tables):
    base = customer_base(customer_rollup(customer_orders(tables)))
    assert tuple(base.columns) == BASE_COLUMNS
    rows = {r["customer_unique_id"]: r for r in base.collect()}
    assert set(rows) == {"ann", "cat"}
    ann, cat = rows["ann"], rows["cat"]
    assert ann["customer_tenure_days"] == 1  # 26 hours, over two midnights
    assert ann["total_orders"] == 2 and ann["total_spend"] == 35.35
    assert ann["customer_state"] == "RJ"
    assert ann["avg_review_score"] == 4.5
    assert ann["recency_days"] == 29
    assert cat["recency_days"] == 0 and cat["customer_state"] == "BA"  # same time: later id
    assert cat["avg_review_score"] is None and cat["primary_seller_state"] is None


def test_duplicate_order_rows_count_once(tables):
    doubled = {**tables, "orders": tables["orders"].union(tables["orders"])}
    rows = customer_rollup(customer_orders(doubled)).collect()
    ann = next(r for r in rows if r["customer_unique_id"] == "ann")
    assert ann["total_orders"] == 2 and ann["total_spend"] == 70.70


def test_sql_over_registered_tables(spark, tables):
    df = run_sql(spark, "select count(*) as n from order_items join products using (product_id)", tables)
    assert df.first()["n"] == 7


def test_parquet_inputs_equal_csv_inputs(spark, tables, tmp_path):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    again = read_parquet_tables(spark, str(tmp_path))
    for name in tables:
        assert sorted(map(str, again[name].collect())) == sorted(map(str, tables[name].collect()))


def test_whole_run_from_csv_to_published_tables(spark, raw_dir, tmp_path, capsys):
    main([str(raw_dir), str(tmp_path), "--file", "sellers=sellers.csv", "--forecast"])
    paths = dict(line.split(": ") for line in capsys.readouterr().out.splitlines())
    assert len(paths) == 11
    detail = spark.read.option("header", True).csv(paths["01_customer_detail"])
    assert detail.count() == 2 and len(detail.columns) == 21
    back = read_published(spark, str(tmp_path))
    assert len(back) == 10 and back["01_customer_detail"].count() == 2
    assert spark.read.parquet(paths["forecast"]).count() == 2
    roi = back["retention_roi"]
    assert roi.count() == 5
    assert roi.filter(F.col("median_clv").isNull()).count() == 0
