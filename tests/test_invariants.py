"""What must hold on any input, on the benchmark tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tallywise.operators import lifetime
from tallywise.params import RETENTION_BUDGET
from tallywise.plans.engine import Engine, engine_for
from tallywise.plans.registry import QUERIES
from tallywise.sources.driver_tables import load_tables
from tallywise.sources.staging import Stages, stage_root

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    return engine_for(spark, SF_DIR)


def test_one_row_per_person(engine):
    persons = engine.customer_orders().select("customer_unique_id").distinct().count()
    for table in (engine.base(), engine.rfm(), engine.scores()):
        assert table.count() == persons
        assert table.select("customer_unique_id").distinct().count() == persons


def test_segments_cover_everyone(engine):
    rows = QUERIES["rfm_segment_breakdown"](engine).collect()
    assert sum(r["customers"] for r in rows) == engine.base().count()
    assert sum(r["customer_pct"] for r in rows) == pytest.approx(100, abs=0.3)


def test_uniform_budget_is_spent(engine):
    spent = engine.current().agg(F.sum("current_budget_allocation")).first()[0]
    assert spent == pytest.approx(RETENTION_BUDGET, abs=0.05)


@pytest.mark.parametrize("budget", [RETENTION_BUDGET, 18_000.0, 1_800.0])
def test_reach_is_filled_exactly(engine, budget):
    reach = {r["rfm_segment"]: r for r in engine.reach(budget).collect()}
    got = {r["rfm_segment"]: r["count"] for r in engine.targeted(budget).groupBy("rfm_segment").count().collect()}
    for segment, row in reach.items():
        assert row["reach"] <= row["segment_size"]
        assert got.get(segment, 0) == row["reach"]


def test_value_shares_add_up(engine):
    for name, column in (("geographic_summary", "clv_share_pct"), ("segment_summary_export", "clv_share_pct")):
        total = QUERIES[name](engine).agg(F.sum(column)).first()[0]
        assert total == pytest.approx(100, abs=1.5)


def test_derived_weights_and_model_run_end_to_end(spark):
    engine = Engine(load_tables(spark, SF_DIR), Stages(spark), score_weights=None, lifespan="auto")
    methods = {r[0] for r in engine.scores().select("lifespan_method").distinct().collect()}
    assert methods == {"BG/NBD" if engine.repeat_model.converged else "empirical"}


def test_the_plan_decides_on_the_lifespan(spark):
    """The scalar in the plan picks one of two methods, row for row."""
    rows = spark.range(3)
    pick = lambda value: {
        r["m"] for r in lifetime.chosen_inputs(
            rows.withColumn("m", F.lit("empirical")), rows.withColumn("m", F.lit("model")),
            spark.createDataFrame([(value,)], "v boolean").scalar(),
        ).collect()
    }
    assert (pick(True), pick(False), pick(None)) == ({"model"}, {"empirical"}, {"empirical"})


def test_later_applications_find_the_stages(spark, engine, tmp_path):
    tables = engine.tables
    first = Engine(tables, Stages(spark, str(tmp_path), source="inputs of one day"))
    want = first.scores().count()
    assert first.stages.built == ["customer_rollup", "rfm_segments_R0.4-F0.35-M0.25", "value_inputs_R0.4-F0.35-M0.25_empirical"]
    again = Engine(tables, Stages(spark, str(tmp_path), source="inputs of one day"))
    assert again.scores().count() == want and again.stages.built == []
    other = Engine(tables, Stages(spark, str(tmp_path), source="inputs of the next day"))
    other.rollup()
    assert other.stages.built == ["customer_rollup"]


def test_own_stages_can_be_removed(spark, tmp_path):
    stages = Stages(spark, str(tmp_path))
    stages.table("x", lambda: spark.range(3))
    stages.close()
    assert not os.path.exists(stages.path)
    named = Stages(spark, str(tmp_path), source="s")
    named.table("x", lambda: spark.range(3))
    named.close()
    assert os.path.exists(f"{named.path}/x/_SUCCESS")


def test_half_written_stage_is_not_read(spark, tmp_path):
    stages = Stages(spark, str(tmp_path))
    (tmp_path / "tallywise").mkdir(exist_ok=True)
    spark.range(9).write.parquet(f"{stages.path}/x")
    os.remove(f"{stages.path}/x/_SUCCESS")
    os.rename(f"{stages.path}/x", f"{stages.path}/_draft-1-x")
    assert stages.table("x", lambda: spark.range(3)).count() == 3


def test_unknown_lifespan_is_refused(engine):
    with pytest.raises(ValueError, match="lifespan"):
        Engine(engine.tables, engine.stages, lifespan="guess")


def test_stage_tables_live_in_the_configured_folder(spark, engine):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert stage_root(spark) == folder and engine.stages.path.startswith(folder)


def test_lost_stage_is_built_again(spark, tmp_path):
    stages = Stages(spark, str(tmp_path / "one"))
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    assert stages.table("x", build).count() == 3
    assert stages.table("x", build).count() == 3 and len(built) == 1
    os.rename(f"{stages.path}/x", tmp_path / "elsewhere")
    assert stages.table("x", build).count() == 3 and len(built) == 2
