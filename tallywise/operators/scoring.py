"""Recency, frequency and monetary scores, the composite and the segments."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.order_stats import Quantile, quantiles, rank_cuts, up_to_cut
from ..functions.values import small_table
from ..params import (
    DEFAULT_WEIGHTS,
    FREQUENCY_BANDS,
    RECENCY_BANDS,
    SEGMENT_MIDPOINTS,
    SEGMENT_RULES,
    SEGMENTS,
)
from ..sources.catalog import require_columns
from .customers import BASE_COLUMNS

REQUIRED = ("customer_unique_id", "recency_days", "total_orders", "total_spend")
SCORES = ("R_score", "F_score", "M_score")
EDGE_PROBS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)


def recency_score(days: Column) -> Column:
    """5 for the most recent buyers down to 1."""
    ladder = F.when(days <= RECENCY_BANDS[0][0], RECENCY_BANDS[0][1])
    for limit, score in RECENCY_BANDS[1:]:
        ladder = ladder.when(days <= limit, score)
    return ladder.otherwise(1)


def frequency_score(orders: Column) -> Column:
    """Absolute order counts: most persons buy once, so quantiles would not split."""
    ladder = F.when(orders >= FREQUENCY_BANDS[0][0], FREQUENCY_BANDS[0][1])
    for needed, score in FREQUENCY_BANDS[1:]:
        ladder = ladder.when(orders >= needed, score)
    return ladder.otherwise(1)


def spend_edges(base: DataFrame) -> DataFrame:
    """One row: persons, and the six edges of five equally filled spend bins."""
    edges = [Quantile(f"edge_{i}", "total_spend", p) for i, p in enumerate(EDGE_PROBS)]
    persons = base.agg(F.count("total_spend")).scalar()
    return quantiles(base, [], edges).select(persons.alias("persons"), "*")


def monetary_score(base: DataFrame) -> Callable[[Column, Column], Column]:
    """The spend score as an expression over (spend, person).

    Bins are closed on the right. When two edges coincide, persons are split by
    rank instead. Six numbers, or the four cut rows, go through the driver, so
    that scoring itself is a projection without join or sort.
    """
    edges = spend_edges(base).first()
    bounds = [edges[f"edge_{i}"] for i in range(6)]
    if edges["persons"] == 0:
        return lambda spend, person: F.lit(1)
    if len(set(bounds)) == 6:
        return lambda spend, person: _bins_passed(
            [F.lit(bound) < spend for bound in bounds[1:5]]
        )
    return ranked_monetary_score(base, edges["persons"])


def ranked_monetary_score(
    base: DataFrame, persons: int
) -> Callable[[Column, Column], Column]:
    """Five bins over the ranks 1..n of (spend, tie key); nothing is ranked.

    Bin k ends at rank 1 + (n - 1) k / 5. Only the rows at those four ranks are
    looked up; each person is then compared with them.
    """
    spark = base.sparkSession
    ends = small_table(
        spark,
        [(k, 1 + (persons - 1) * k // 5) for k in range(1, 5)],
        "cut int, rank long",
    )
    cuts = rank_cuts(base, [], F.col("total_spend"), "customer_unique_id", ends).collect()
    return lambda spend, person: _bins_passed([
        ~up_to_cut(spend, person, F.lit(c["cut_value"]), F.lit(c["cut_tie"])) for c in cuts
    ])


def _bins_passed(conditions: list[Column]) -> Column:
    return reduce(
        lambda total, passed: total + F.when(passed, 1).otherwise(0), conditions, F.lit(1)
    )


def composite(weights: Mapping[str, float] = DEFAULT_WEIGHTS) -> Column:
    """Weighted score to two places; weights have two places, so whole hundredths."""
    parts = [F.col(f"{k}_score") * F.lit(round(weights[k] * 100)) for k in ("R", "F", "M")]
    return (parts[0] + parts[1] + parts[2]) / F.lit(100.0)


def matched_segment() -> Column:
    """Segment by the first rule that holds, null when none does."""
    return F.coalesce(*[F.when(F.expr(rule), name) for name, rule in SEGMENT_RULES])


def nearest_segment() -> Column:
    """Segment whose midpoint is closest to the composite; the earlier on a tie."""
    candidates = F.array(*[
        F.struct(
            F.abs(F.lit(SEGMENT_MIDPOINTS[name]) - F.col("rfm_composite")).alias("distance"),
            F.lit(place).alias("place"),
            F.lit(name).alias("name"),
        )
        for place, name in enumerate(SEGMENTS)
    ])
    return F.array_min(candidates)["name"]


def assign_segments(scored: DataFrame) -> DataFrame:
    return scored.withColumn("rfm_segment", F.coalesce(matched_segment(), nearest_segment()))


def rfm_segments(
    base: DataFrame, weights: Mapping[str, float] = DEFAULT_WEIGHTS
) -> DataFrame:
    """Customer base with scores, composite and segment."""
    return segment_scored(score(base), weights)


def score(base: DataFrame) -> DataFrame:
    """Customer base with the three scores."""
    require_columns(base, REQUIRED, "customer base")
    spend_score = monetary_score(base)
    return base.select(
        *BASE_COLUMNS,
        recency_score(F.col("recency_days")).alias("R_score"),
        frequency_score(F.col("total_orders")).alias("F_score"),
        spend_score(F.col("total_spend"), F.col("customer_unique_id")).alias("M_score"),
    )


def segment_scored(
    scored: DataFrame, weights: Mapping[str, float] = DEFAULT_WEIGHTS
) -> DataFrame:
    return assign_segments(scored.withColumn("rfm_composite", composite(weights)))


def segment_catch_all(rfm: DataFrame) -> DataFrame:
    """Score cells no rule matches, with the segment each falls to."""
    return (
        rfm.filter(matched_segment().isNull())
        .groupBy(*SCORES, "rfm_composite", "rfm_segment")
        .agg(F.count(F.lit(1)).alias("customers"))
    )
