"""Published versions: whole or not there."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tallywise.sources.catalog import run_sql
from tallywise.sources.publish import drop_older, publish, read_published, versions


def tables(spark, n):
    day = datetime.datetime(2018, 5, 1, 12, 30)
    flat = spark.createDataFrame(
        [(i, i / 7, f'a "quoted", text {i}' if i else None, day) for i in range(n)],
        "k long, v double, t string, at timestamp_ntz",
    )
    return {"whole": spark.range(n), "flat": flat}


def test_types_and_values_come_back(spark, tmp_path):
    given = tables(spark, 5)
    paths = publish(spark, str(tmp_path), given, flat=["flat"], single=["flat"])
    back = read_published(spark, str(tmp_path))
    for name, df in given.items():
        assert back[name].schema.simpleString() == df.schema.simpleString()
        assert sorted(map(str, back[name].collect())) == sorted(map(str, df.collect()))
    assert set(paths) == {"whole", "flat"} and spark.read.parquet(paths["whole"]).count() == 5


def test_a_broken_run_leaves_the_old_version(spark, tmp_path):
    publish(spark, str(tmp_path), tables(spark, 2), flat=["flat"])
    broken = {"whole": spark.range(9), "flat": spark.range(9).select(F.raise_error(F.lit("stop")).cast("string").alias("x"))}
    with pytest.raises(Exception, match="stop"):
        publish(spark, str(tmp_path), broken, flat=["flat"])
    assert read_published(spark, str(tmp_path))["whole"].count() == 2
    publish(spark, str(tmp_path), tables(spark, 3), flat=["flat"])
    assert read_published(spark, str(tmp_path))["whole"].count() == 3


def test_a_reader_keeps_its_version_until_it_is_dropped(spark, tmp_path):
    for n in (1, 2, 3):
        publish(spark, str(tmp_path), tables(spark, n))
        if n == 1:
            reader = read_published(spark, str(tmp_path))["whole"]
    assert reader.count() == 1 and len(versions(spark, str(tmp_path))) == 3
    drop_older(spark, str(tmp_path), keep=1)
    assert len(versions(spark, str(tmp_path))) == 1
    assert read_published(spark, str(tmp_path))["whole"].count() == 3


def test_nothing_published(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_published(spark, str(tmp_path / "none"))


def test_names_hold_inside_one_query_only(spark):
    one, two = spark.range(1).withColumn("t", F.lit("{x}")), spark.range(2)
    first = run_sql(spark, "WITH a AS (SELECT * FROM orders) SELECT count(*) AS n, max(t) AS t FROM a WHERE t = '{x}'", {"orders": one})
    second = run_sql(spark, "SELECT count(*) AS n FROM orders", {"orders": two})
    assert tuple(first.first()) == (1, "{x}") and second.first()["n"] == 2
    assert "orders" not in [t.name for t in spark.catalog.listTables()]
