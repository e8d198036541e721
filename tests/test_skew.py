"""The queries on inputs where single keys and values hold a third of the rows."""

from __future__ import annotations

import duckdb
import pytest

from tallywise.plans.oracles import ORACLES
from tallywise.plans.registry import all_queries
from test_queries import SF_DIR, rows_of

BASE = ("orders", "lineitem", "customer", "nation", "part", "supplier")
NAMES = (
    "customer_orders",
    "customer_base",
    "spend_quintile_edges",
    "monetary_score",
    "monetary_score_ranked",
    "rfm_segments",
    "value_target",
    "clv_scores",
    "clv_summary",
    "clv_sensitivity",
    "segment_summary_export",
    "geographic_summary",
    "clv_box_stats",
    "targeted_customers_tight",
    "retention_roi_tight",
    "bgnbd_summary",
)


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """One person, one order, one product and one seller on a third of the rows
    each, and a third of the persons with one and the same order."""
    folder = tmp_path_factory.mktemp("skew")
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create table {t} as select * from '{SF_DIR}/{t}.parquet'")
    con.execute("update orders set o_orderstatus = 'F'")
    con.execute("update orders set o_custkey = 1 where o_orderkey % 3 = 0")
    # Persons 1001.. have one order each, all alike.
    con.execute("""
        insert into customer
        select 1000 + i, 'Customer', 3, 0.0, 'BUILDING' from range(1, 101) t(i)""")
    con.execute("""
        insert into orders
        select 900000 + i, 1000 + i, 'F', 10.0, timestamp '1999-05-05', '1-URGENT'
        from range(1, 101) t(i)""")
    con.execute("""
        insert into lineitem
        select 900000 + i, 1, 1, 1, 1.0, 100.0, 0.0, 0.0, 'N', 'F', timestamp '1999-06-06'
        from range(1, 101) t(i)""")
    con.execute("update lineitem set l_orderkey = 7 where l_orderkey < 900000 and l_linenumber % 3 = 0")
    con.execute("update lineitem set l_partkey = 2 where l_linenumber % 3 = 1")
    con.execute("update lineitem set l_suppkey = 3 where l_linenumber % 3 = 2")
    for t in BASE:
        con.execute(f"copy {t} to '{folder}/{t}.parquet' (format parquet)")
    return str(folder), con


def test_equal_spends_make_edges_coincide(spark, skewed):
    folder, _ = skewed
    row = all_queries()["spend_quintile_edges"](spark, folder).first()
    assert len({row[f"edge_{i}"] for i in range(6)}) < 6


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql_under_skew(spark, skewed, name):
    folder, con = skewed
    df = all_queries()[name](spark, folder)
    cursor = con.execute(ORACLES[name])
    expected = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(df.columns, df.collect()) == expected
