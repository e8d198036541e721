"""Score weights derived from the data, and when not to trust them."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.order_stats import Quantile, quantiles
from ..functions.values import round_even
from ..params import COLLAPSE_LIMIT, DEFAULT_TOLERANCE, DEFAULT_WEIGHTS
from .scoring import SCORES

DIMENSIONS = ("R", "F", "M")


def value_target(scored: DataFrame) -> DataFrame:
    """Mark persons whose average order value lies above the median."""
    middle = quantiles(scored, [], [Quantile("median_order_value", "avg_order_value")]).scalar()
    above = F.coalesce(F.col("avg_order_value") > middle, F.lit(False))
    return scored.withColumn("high_value", above.cast("int"))


def score_cells(target: DataFrame) -> DataFrame:
    """Persons per score combination and target: 250 rows at most."""
    return target.groupBy(*SCORES, "high_value").agg(F.count(F.lit(1)).alias("persons"))


def standardized_scores(scored: DataFrame) -> DataFrame:
    """Scores centred and divided by their population deviation (1 when it is 0)."""
    moments = scored.agg(*[
        f(c).alias(f"{c}_{name}")
        for c in SCORES
        for f, name in ((F.avg, "mean"), (F.stddev_pop, "deviation"))
    ])
    wide = scored.withColumn("moments", moments.select(F.struct("*")).scalar())
    for c in SCORES:
        deviation = F.col(f"moments.{c}_deviation")
        scale = F.when(deviation > 0, deviation).otherwise(1.0)
        wide = wide.withColumn(f"{c[0]}_std", (F.col(c) - F.col(f"moments.{c}_mean")) / scale)
    return wide.drop("moments")


def fit_coefficients(target: DataFrame) -> DataFrame:
    """One row of coefficients of a class-balanced, L2-penalised logistic fit.

    Persons enter as weighted score cells: 250 rows at most whatever the number
    of persons, so they are fetched once and the iterations run over those.
    Zeros when one class is absent.
    """
    spark = target.sparkSession
    cells = score_cells(target).collect()
    persons = sum(c["persons"] for c in cells)
    per_class = {
        y: sum(c["persons"] for c in cells if c["high_value"] == y) for y in (0, 1)
    }
    if not all(per_class.values()):
        return spark.range(1).select(*[F.lit(0.0).alias(d) for d in DIMENSIONS])

    means = [sum(c[s] * c["persons"] for c in cells) / persons for s in SCORES]
    spreads = [
        math.sqrt(sum((c[s] - m) ** 2 * c["persons"] for c in cells) / persons) or 1.0
        for s, m in zip(SCORES, means, strict=True)
    ]
    frame = spark.createDataFrame(
        [
            (
                Vectors.dense([(c[s] - m) / d for s, m, d in zip(SCORES, means, spreads, strict=True)]),
                float(c["high_value"]),
                c["persons"] * persons / (2.0 * per_class[c["high_value"]]),
            )
            for c in cells
        ],
        ["features", "label", "weight"],
    ).coalesce(1)
    model = LogisticRegression(
        weightCol="weight",
        regParam=1.0 / persons,
        elasticNetParam=0.0,
        standardization=False,
        maxIter=1000,
        tol=1e-12,
    ).fit(frame)
    return spark.range(1).select(*[
        F.lit(float(v)).alias(d)
        for d, v in zip(DIMENSIONS, model.coefficients, strict=True)
    ])


def weight_policy(coefficients: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Coefficients R, F, M to usable weights, beside the columns in ``keep``.

    The defaults stand when one dimension takes more than 60 % (the fit has
    collapsed onto it) or when no weight is more than 5 points away from its
    default. Otherwise weights are rounded to two places and the largest one
    absorbs what is missing to 1.
    """
    total = sum((F.abs(F.col(d)) for d in DIMENSIONS), F.lit(0.0))
    shares = coefficients.select(*keep, *[
        round_even(F.try_divide(F.abs(F.col(d)), total), 4).alias(d) for d in DIMENSIONS
    ])
    largest = F.greatest(*DIMENSIONS)
    away = F.greatest(*[F.abs(F.col(d) - F.lit(DEFAULT_WEIGHTS[d])) for d in DIMENSIONS])
    decision = (
        F.when(F.col("R").isNull(), "undefined")
        .when(largest > COLLAPSE_LIMIT, "collapsed")
        .when(away <= DEFAULT_TOLERANCE, "near_default")
        .otherwise("derived")
    )
    rounded = {d: round_even(F.col(d), 2) for d in DIMENSIONS}
    missing = F.lit(1.0) - (rounded["R"] + rounded["F"] + rounded["M"])
    top = F.greatest(*rounded.values())
    # The first dimension that holds the maximum gets the remainder.
    heaviest = (
        F.when(rounded["R"] == top, "R").when(rounded["F"] == top, "F").otherwise("M")
    )

    def final(d: str) -> Column:
        adjusted = F.when(heaviest == d, round_even(rounded[d] + missing, 2)).otherwise(
            rounded[d]
        )
        return F.when(F.col("decision") == "derived", adjusted).otherwise(
            F.lit(DEFAULT_WEIGHTS[d])
        )

    return shares.withColumn("decision", decision).select(
        *keep,
        *[F.col(d).alias(f"share_{d}") for d in DIMENSIONS],
        "decision",
        *[final(d).alias(f"weight_{d}") for d in DIMENSIONS],
    )


def derive_weights(scored: DataFrame) -> Mapping[str, float]:
    """Fit and decide; three numbers come back to the driver."""
    row = weight_policy(fit_coefficients(value_target(scored))).first()
    return {d: row[f"weight_{d}"] for d in DIMENSIONS}


def score_target_correlation(target: DataFrame) -> DataFrame:
    """Correlation of each score with the target, from whole-number sums."""
    y = F.col("high_value")
    n = F.count(F.lit(1))

    def correlation(c: str) -> Column:
        x = F.col(c)
        covered = n * F.sum(x * y) - F.sum(x) * F.sum(y)
        spread = (n * F.sum(x * x) - F.sum(x) * F.sum(x)).cast("double") * (
            n * F.sum(y) - F.sum(y) * F.sum(y)
        ).cast("double")
        return round_even(F.coalesce(F.try_divide(covered.cast("double"), F.sqrt(spread)), F.lit(0.0)), 6)

    return target.agg(*[correlation(c).alias(c[0]) for c in SCORES])
