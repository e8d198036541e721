from __future__ import annotations

import numpy as np
import pytest

from builders import base_table, person
from tallywise.operators import scoring, weights


def policy(spark, r, f, m):
    row = weights.weight_policy(spark.createDataFrame([(r, f, m)], "R double, F double, M double")).first()
    return row["decision"], (row["weight_R"], row["weight_F"], row["weight_M"])


def test_weight_policy_branches(spark):
    default = (0.40, 0.35, 0.25)
    assert policy(spark, 0.1, -0.2, 0.9) == ("collapsed", default)
    assert policy(spark, 0.38, 0.36, -0.26) == ("near_default", default)
    assert policy(spark, 0.0, 0.0, 0.0) == ("undefined", default)
    decision, chosen = policy(spark, 1.0, -1.0, 1.0)
    assert decision == "derived" and chosen == (0.34, 0.33, 0.33)
    assert policy(spark, 0.2, 0.3, 0.5) == ("derived", (0.2, 0.3, 0.5))
    # Equality with a limit is on the safe side of each test.
    assert policy(spark, 0.6, 0.2, 0.2)[0] == "derived"


def people(n=400, seed=3):
    rng = np.random.default_rng(seed)
    return [
        person(
            f"p{i}",
            orders=int(rng.integers(1, 6)),
            spend=float(np.round(rng.lognormal(4, 0.7), 2)),
            recency=int(rng.integers(0, 250)),
        )
        for i in range(n)
    ]


def newton(x, y, sample_weight, penalty):
    """Unpenalised intercept last; minimises weighted log loss + penalty/2 |w|^2."""
    design = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag([penalty] * x.shape[1] + [0.0])
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = design.T @ (sample_weight * (p - y)) + ridge @ beta
        hessian = design.T @ (design * (sample_weight * p * (1 - p))[:, None]) + ridge
        beta -= np.linalg.solve(hessian, gradient)
    return beta[:-1]


def test_coefficients_match_a_direct_fit_on_all_persons(spark):
    scored = scoring.score(base_table(spark, people()))
    target = weights.value_target(scored)
    got = weights.fit_coefficients(target).first()
    rows = target.toPandas()
    y = rows["high_value"].to_numpy(float)
    assert (y == (rows.avg_order_value > rows.avg_order_value.median())).all()
    x = rows[["R_score", "F_score", "M_score"]].to_numpy(float)
    x = (x - x.mean(0)) / x.std(0)
    balance = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    expected = newton(x, y, balance, 1.0)
    assert [got[d] for d in "RFM"] == pytest.approx(list(expected), abs=1e-4)


def test_single_class_target_keeps_the_defaults(spark):
    same = base_table(spark, [person(f"p{i}", spend=10.0) for i in range(6)])
    assert weights.derive_weights(scoring.score(same)) == {"R": 0.40, "F": 0.35, "M": 0.25}


def test_standardized_scores(spark):
    scored = scoring.score(base_table(spark, people(60)))
    rows = weights.standardized_scores(scored).toPandas()
    for d in "RFM":
        s = rows[f"{d}_score"].to_numpy(float)
        assert rows[f"{d}_std"].to_numpy() == pytest.approx((s - s.mean()) / s.std(), abs=1e-9)
    flat = base_table(spark, [person(f"p{i}", spend=i + 1) for i in range(5)])
    assert {r["F_std"] for r in weights.standardized_scores(scoring.score(flat)).collect()} == {0.0}
