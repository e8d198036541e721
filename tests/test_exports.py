from __future__ import annotations

from builders import as_dict, person, segmented
from tallywise.operators import exports, lifetime, profile
from tallywise.params import SEGMENTS

LOYAL, LOST = "Loyal Customers", "Lost Customers"


def scores(spark):
    rows = [
        (person("a", spend=100, state="SP", seller="SP"), LOYAL, 4, 3, 3),
        (person("b", spend=300, state="SP", seller="RJ"), LOYAL, 4, 3, 5),
        (person("c", spend=50, state="SP", seller=None), LOST, 1, 1, 1),
        (person("d", spend=40, state="MG", seller=None), LOST, 1, 1, 1),
    ]
    return lifetime.clv_scores(lifetime.value_inputs(segmented(spark, rows)))


def test_summary_lists_all_segments_in_order(spark):
    rows = exports.segment_summary(scores(spark)).collect()
    assert [r["rfm_segment"] for r in rows] == list(SEGMENTS)
    assert rows[0]["customer_count"] is None and rows[0]["segment_sort_order"] is None
    assert rows[1]["customer_pct"] == 50.0 and rows[1]["segment_sort_order"] == 2
    assert len(rows[0]) == 19
    assert abs(sum(r["clv_share_pct"] or 0 for r in rows) - 100) < 0.2


def test_states_without_known_sellers(spark):
    geo = as_dict(
        exports.geographic_summary(scores(spark)), "customer_state",
        "customer_count", "top_seller_state", "local_seller_pct",
    )
    assert geo == {"SP": (3, "RJ", 33.3), "MG": (1, "Unknown", 0.0)}


def test_crosstab_has_every_cell(spark):
    rows = {r["R_score"]: r for r in exports.rf_crosstab(scores(spark)).collect()}
    assert len(rows) == 5 and rows[4]["f3"] == 2 and rows[1]["f1"] == 2
    assert rows[5]["f5"] == 0 and rows[5]["log10_f5"] is None
    assert rows[4]["log10_f3"] == 0.30103


def test_box_statistics(spark):
    rows = [(person(f"p{i}", spend=v), LOYAL, 2, 1, 1) for i, v in enumerate([10, 11, 12, 13, 14, 100, 0])]
    frame = lifetime.clv_scores(lifetime.value_inputs(segmented(spark, rows)))
    box = exports.clv_box_stats(frame).filter(f"rfm_segment = '{LOYAL}'").first()
    assert box["customers"] == 6 and box["outliers"] == 1
    assert (box["whisker_low"], box["whisker_high"]) == (6.5, 9.1)
    assert (box["q1"], box["median"], box["q3"]) == (7.31, 8.12, 8.94)


def test_histogram_folds_rare_counts(spark):
    frame = spark.createDataFrame([(k, ) for k in range(1, 15) for _ in range(k)], "total_orders long")
    got = as_dict(profile.frequency_histogram(frame), "orders", "customers")
    assert got["10"] == 10 and got["11+"] == 11 + 12 + 13 + 14 and len(got) == 11


def test_quality_flags(spark):
    row = profile.quality_flags(scores(spark)).first()
    assert (row["customers"], row["distinct_segments"], row["clv_nulls"], row["zero_spend"]) == (4, 2, 0, 0)


def test_single_files_for_small_exports(spark, tmp_path):
    written = exports.write_exports(
        {"02_segment_summary": exports.segment_summary(scores(spark))}, str(tmp_path)
    )
    folder = tmp_path / "02_segment_summary"
    assert written == {"02_segment_summary": str(folder)}
    assert len(list(folder.glob("*.csv"))) == 1
