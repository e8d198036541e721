"""The pipeline's stages against their operators alone, on the given tables and on odd rows."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallywise.llm import mixing, near_dedup, quality_rules, toxicity

SF_DIR = "/root/testdata/sf0.001"


def bag(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """(stage, its input, its output) of a run over the given documents."""
    out, docs = [], spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, SF_DIR).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_order_and_columns(steps):
    assert list(steps) == ["quality_rules", "toxicity", "near_dedup", "source_mixing", "packing"]
    for before, after in list(steps.values())[:-1]:
        assert before.columns == after.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_does_what_its_operator_decides(spark, steps):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    before, after = steps["quality_rules"]
    judged = quality_rules.judge(before, labels).where("kept").select("doc_id")
    assert bag(after.select("doc_id")) == bag(judged)
    before, after = steps["toxicity"]
    clean = toxicity.score(before, labels).where(F.col("score") < toxicity.CUTOFF).select("doc_id")
    assert bag(after.select("doc_id")) == bag(clean)
    before, after = steps["near_dedup"]
    heads = near_dedup.link(before).where("kept").select("doc_id")
    assert bag(after.select("doc_id")) == bag(heads)
    before, after = steps["source_mixing"]
    assert bag(after) == bag(mixing.mix(before).select(before.columns))
    before, after = steps["packing"]
    pieces = Counter(r.doc_id for r in after.where("piece = 0").collect())
    assert pieces == Counter(r.doc_id for r in before.collect())
    for r in after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.expr("offset + length")).alias("end")).collect():
        assert r.n == r.end <= 2048


def test_odd_rows_run_through(spark, docs, labels, odd, clashing, tmp_path):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("tre", "mol", "san", "vik") for b in ("da", "ren", "tos", "lia")]
    good = [(100 + i, " ".join(rng.choices(words, k=80)), "en", f"s{i % 3}") for i in range(60)]
    rows = clashing(docs([*odd, *good, *good[:20]]))
    labels([(100 + i, 1, 0) for i in range(40)]).write.parquet(f"{tmp_path}/labels.parquet")
    now = rows
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == rows.columns
    ids = {r.doc_id for r in now.select("doc_id").collect()}
    assert ids == {100 + i for i in range(60)}  # of the odd rows all have too few words or repeat one
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == ids


def test_empty_tables(spark, docs, labels, tmp_path):
    labels([]).write.parquet(f"{tmp_path}/labels.parquet")
    docs([]).where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
