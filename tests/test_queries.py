"""Every named query against its SQL counterpart, and the plans they run."""

from __future__ import annotations

import io
import math
import re
from contextlib import redirect_stdout

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tallywise.operators import orders
from tallywise.plans.engine import engine_for
from tallywise.plans.oracles import ORACLES
from tallywise.plans.registry import all_queries

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
QUERIES = all_queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = [
        tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order)
        for r in records
    ]
    return [columns[i] for i in order], sorted(clean, key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(ORACLES[name])
    expected = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(df.columns, df.collect()) == expected


def test_entry(spark):
    assert contract.entry(spark).count() == 5


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_stay_in_the_jvm(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert not re.search("Python|InArrow|InPandas|CartesianProduct", plan)


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    tables = engine_for(spark, SF_DIR).tables
    tables["orders"].withColumn("unused", F.lit(1)).write.parquet(f"{tmp_path}/orders")
    plan = plan_of(orders.filtered_orders(spark.read.parquet(f"{tmp_path}/orders")))
    assert "EqualTo(order_status,delivered)" in plan
    assert "IsNotNull(order_delivered_customer_date)" in plan
    assert "unused" not in plan
    scan = plan_of(orders.payments_by_order(tables["order_payments"]))
    assert "l_shipdate" not in scan and "l_extendedprice" in scan


def test_no_join_pairs_whole_tables(spark):
    plan = plan_of(engine_for(spark, SF_DIR).base())
    assert "NestedLoop" not in plan and "Subquery" in plan


def test_stage_tables_are_shared_while_inputs_stay_the_same(spark):
    assert engine_for(spark, SF_DIR) is engine_for(spark, SF_DIR)
