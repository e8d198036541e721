"""The forecast's series is summed to the end, also where its terms fall off slowly."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tallywise.operators import repeat_model as rm


def summed(r, alpha, a, b, x, t_x, period, days=730.0):
    """The Euler-transformed series with plain floats, until terms vanish."""
    z = days / (alpha + period + days)
    term = total = (a + b - 1 - r) / (a + b - 1 + x) * z
    k = 1
    while abs(term) > 1e-20 * abs(total) and k < 3_000_000:
        term *= (a + b - 1 - r + k) * (a - 1 + k) / ((a + b - 1 + x + k) * (k + 1)) * z
        total += term
        k += 1
    spread = -math.log(1 - z) if a == 1 else ((1 - (1 - z) ** (a - 1)) / (a - 1))
    odds = a / (b + x - 1) * ((alpha + period) / (alpha + t_x)) ** (r + x) if x else 0.0
    return (a + b - 1 + x) * (spread - (1 - z) ** (a - 1) * total) / (1 + odds)


@pytest.mark.parametrize(
    ("params", "history", "known"),
    [
        ((0.25, 4.0, 0.8, 2.4), (0, 0, 1), 5.4979),
        ((0.25, 0.2, 0.8, 2.4), (0, 0, 1), 9.6115),
        ((0.5, 1.0, 0.3, 0.4), (0, 0, 1), 27.2179),
        ((0.9, 120.0, 0.6, 2.5), (3, 100, 300), None),
        ((0.9, 12.0, 1.0, 2.5), (2, 10, 30), None),
        ((0.3, 0.5, 4.5, 1.5), (0, 0, 2), None),
    ],
)
def test_series(spark, params, history, known):
    columns = [*rm.HISTORY, "customers"]
    df = spark.createDataFrame([(*map(float, history), 1)], ", ".join(f"{c} double" for c in columns[:3]) + ", customers long")
    named = dict(zip(rm.PARAMETERS, params, strict=True))
    got = rm.expected_orders(df, named, 730.0).first()["expected"]
    assert got == pytest.approx(summed(*params, *history), rel=1e-9)
    if known:
        assert got == pytest.approx(known, abs=6e-5)


@pytest.mark.parametrize("params", [(0.6, 8.0, 0.9, 2.0), (2.4, 1600.0, 1e-12, 1e-4), (1.5, 0.01, 30.0, 2.5), (0.4, 3.0, 2.0, 1e-5)])
def test_simulated_forecast(spark, params):
    """The mean over the posterior, drawn at random: p from a Beta, orders given p in closed form."""
    r, alpha, a, b = params
    rng = np.random.default_rng(3)
    rows = [(0, 0, 40), (1, 15, 40), (6, 300, 410), (900, 500, 520)]
    df = spark.createDataFrame([(*h, 1) for h in rows], "frequency long, recency int, T int, customers long")
    got = {g.frequency: g.expected for g in rm.expected_orders(df, dict(zip(rm.PARAMETERS, params, strict=True))).collect()}
    for x, t_x, period in rows:
        p = np.maximum(rng.beta(a, b + x, 400_000), 1e-300)
        mean = (-np.expm1(-(r + x) * np.log1p(p * 730 / (alpha + period))) / p).mean()
        odds = a / (b + x - 1) * ((alpha + period) / (alpha + t_x)) ** (r + x) if x else 0.0
        assert got[x] == pytest.approx(mean / (1 + odds), rel=0.01)
