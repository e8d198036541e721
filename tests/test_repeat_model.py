from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from builders import base_table, person
from tallywise.operators import repeat_model as rm

PARAMS = {"r": 0.8, "alpha": 40.0, "a": 0.7, "b": 3.0}


def log_likelihood(x, t_x, period, r, alpha, a, b):
    """The formula of the paper, one history at a time."""
    g = math.lgamma
    head = g(r + x) - g(r) + r * math.log(alpha)
    beta = g(a + b) + g(b + x) - g(b) - g(a + b + x)
    alive = (alpha + period) ** -(r + x)
    gone = a / (b + x - 1) * (alpha + t_x) ** -(r + x) if x > 0 else 0.0
    return head + beta + math.log(alive + gone)


@pytest.fixture(scope="module")
def simulated(spark):
    """Buyers who behave as the model says, with known parameters."""
    rng = np.random.default_rng(11)
    histories = []
    for _ in range(6000):
        rate = rng.gamma(PARAMS["r"], 1 / PARAMS["alpha"])
        drop = rng.beta(PARAMS["a"], PARAMS["b"])
        period = int(rng.integers(200, 700))
        now, x, last = 0.0, 0, 0.0
        while True:
            now += rng.exponential(1 / rate)
            if now > period:
                break
            x, last = x + 1, now
            if rng.random() < drop:
                break
        histories.append((x, int(last), period))
    df = spark.createDataFrame(histories, "frequency long, recency int, T int")
    return rm.distinct_histories(df).persist()


def test_ln_gamma(spark):
    points = [0.01, 0.5, 1.0, 2.0, 3.7, 25.0, 1e3, 1e9]
    df = spark.createDataFrame([(z,) for z in points], "z double")
    got = [r[0] for r in df.select(rm.ln_gamma(F.col("z"))).collect()]
    assert got == pytest.approx([math.lgamma(z) for z in points], rel=1e-12, abs=1e-11)


def test_likelihood_matches_the_paper(spark):
    rows = [(0, 0, 10, 2), (1, 0, 5, 1), (3, 200, 350, 4), (40, 600, 640, 1)]
    df = spark.createDataFrame(rows, "frequency long, recency int, T int, customers long")
    got = rm.grid_log_likelihood(df, [PARAMS]).first()
    expected = sum(n * log_likelihood(x, t, p, **PARAMS) for x, t, p, n in rows)
    assert got["log_likelihood"] == pytest.approx(expected, rel=1e-10)
    assert got["customers"] == 8


def test_very_frequent_buyer_stays_finite(spark):
    df = spark.createDataFrame([(10**9, 700, 701, 1)], "frequency long, recency int, T int, customers long")
    assert math.isfinite(rm.grid_log_likelihood(df, [PARAMS]).first()["log_likelihood"])
    assert 0 <= df.select(rm.prob_alive(PARAMS)).first()[0] <= 1


def test_fit_recovers_simulated_behaviour(spark, simulated):
    model = rm.fit(simulated, penalty=0.0)
    assert model.converged
    assert model.r == pytest.approx(PARAMS["r"], rel=0.2)
    assert model.alpha == pytest.approx(PARAMS["alpha"], rel=0.25)
    assert model.a / (model.a + model.b) == pytest.approx(0.7 / 3.7, rel=0.3)
    cells = [model.params()] + [
        {**model.params(), p: getattr(model, p) * f} for p in rm.PARAMETERS for f in (0.9, 1.1)
    ]
    scores = {r["cell"]: r["log_likelihood"] for r in rm.grid_log_likelihood(simulated, cells).collect()}
    assert max(scores, key=scores.get) == 0


def mean_log_likelihood(rows, logs, penalty, scale):
    r, a, b = np.exp(logs[0]), np.exp(logs[2]), np.exp(logs[3])
    alpha = np.exp(logs[1]) / scale
    total = sum(n * log_likelihood(x, t, p, r, alpha, a, b) for x, t, p, n in rows)
    return total / sum(n for *_, n in rows) - penalty * float(np.exp(2 * np.asarray(logs)).sum())


def direct_optimum(rows, penalty):
    """Newton steps with derivatives by differences, in plain Python."""
    scale = 10.0 / max(p for _, _, p, _ in rows)
    point, h = np.zeros(4), 1e-3
    f = lambda q: mean_log_likelihood(rows, q, penalty, scale)
    for _ in range(60):
        axes = np.eye(4) * h
        slopes = np.array([(f(point + e) - f(point - e)) / (2 * h) for e in axes])
        bend = np.array([
            [(f(point + e + g) - f(point + e - g) - f(point - e + g) + f(point - e - g)) / (4 * h * h) for g in axes] for e in axes
        ])
        value, vector = np.linalg.eigh(bend)
        step = vector @ (vector.T @ slopes / np.maximum(np.abs(value), 1e-9))
        step /= max(1.0, np.abs(step).max())
        while f(point + step) < f(point) and np.abs(step).max() > 1e-12:
            step /= 2
        point = point + step
        if np.abs(step).max() < 1e-10:
            break
    # The differences' own error, of order h^2, is taken out.
    wide = np.array([(f(point + 2 * e) - f(point - 2 * e)) / (4 * h) for e in axes])
    near = np.array([(f(point + e) - f(point - e)) / (2 * h) for e in axes])
    point = point - np.linalg.solve(bend, (4 * near - wide) / 3)
    return np.exp(point) / np.array([1, scale, 1, 1])


@pytest.mark.parametrize("penalty", [0.0, 0.001])
def test_fit_equals_a_direct_optimiser(spark, simulated, penalty):
    model = rm.fit(simulated, penalty=penalty)
    rows = [(r.frequency, r.recency, r.T, r.customers) for r in simulated.collect()]
    assert model.converged and max(map(abs, model.slopes)) <= 1e-9
    assert list(model.params().values()) == pytest.approx(direct_optimum(rows, penalty), rel=1e-5)


def test_slopes_and_curvature_are_those_of_the_likelihood(simulated):
    likelihood, h = rm.Likelihood(simulated), 1e-5
    here = likelihood.at(PARAMS)
    for i, p in enumerate(rm.PARAMETERS):
        d = h * PARAMS[p]
        up, down = (likelihood.at({**PARAMS, p: PARAMS[p] + s * d}) for s in (1, -1))
        assert (up.value - down.value) / (2 * d) == pytest.approx(here.slopes[i], rel=1e-4, abs=1e-7)
        assert (up.slopes - down.slopes) / (2 * d) == pytest.approx(here.curvature[i], rel=1e-4, abs=1e-7)


def test_nobody_leaves(spark):
    """Steady buyers: the best chance to leave is 0, and the fit says so."""
    rng = np.random.default_rng(2)
    rows = [(int(rng.poisson(period / rng.gamma(4, 20))), period - 5, period, 1) for period in rng.integers(200, 900, 400).tolist()]
    df = spark.createDataFrame([r for r in rows if r[0]], "frequency long, recency int, T int, customers long").distinct()
    model = rm.fit(df)
    assert model.converged and model.a == 0
    assert df.select(F.min(rm.prob_alive(model.params()))).first()[0] == 1
    forecast = rm.forecast_histories(rm.distinct_histories(df), model.params())
    tiny = rm.forecast_histories(rm.distinct_histories(df), {**model.params(), "a": 1e-14, "b": 1.0})
    rows = lambda f: [tuple(r)[:3] + (round(r["expected_purchases"], 4),) for r in f.orderBy(*rm.HISTORY).collect()]
    assert rows(forecast) == rows(tiny)


def test_digamma_and_trigamma(spark):
    points = [1e-6, 0.3, 1.0, 2.5, 40.0, 1e7]
    df = spark.createDataFrame([(z,) for z in points], "z double")
    rows = df.select("z", rm.digamma(F.col("z")).alias("d"), rm.trigamma(F.col("z")).alias("t")).collect()
    for r in rows:
        assert (r.d, r.t) == pytest.approx((rm.digamma(r.z, math.log), rm.trigamma(r.z)), rel=1e-12)
    assert rm.digamma(1.0, math.log) == pytest.approx(-0.57721566490153286, rel=1e-13)
    assert rm.digamma(0.25, math.log) == pytest.approx(-4.2274535333762654, rel=1e-13)
    assert rm.trigamma(1.0) == pytest.approx(math.pi**2 / 6, rel=1e-13)
    assert rm.trigamma(0.5) == pytest.approx(math.pi**2 / 2, rel=1e-13)


def test_forecast_covers_every_person(spark):
    people = [person("new", recency=0), person("one", recency=50), person("two", orders=2, recency=50, tenure=20), person("2", orders=2, recency=50, tenure=20)]
    df = base_table(spark, people).withColumn("rfm_segment", F.lit("x"))
    rows = {r["customer_unique_id"]: r for r in rm.forecast(df, PARAMS).collect()}
    assert set(rows) == {"new", "one", "two", "2"}
    assert rows["new"]["expected_purchases"] is None and rows["new"]["prob_alive"] is None
    assert rows["two"]["expected_purchases"] == rows["2"]["expected_purchases"] > 0


def test_no_histories_do_not_converge(simulated):
    assert not rm.fit(simulated.filter("false")).converged


def test_forecast_matches_direct_series(spark):
    rows = [(0, 0, 10), (2, 100, 400), (7, 300, 310)]
    df = spark.createDataFrame([(*h, 1) for h in rows], "frequency long, recency int, T int, customers long")
    got = {row["frequency"]: row["expected"] for row in rm.expected_orders(df, PARAMS).collect()}
    r, alpha, a, b = (PARAMS[p] for p in rm.PARAMETERS)
    for x, t_x, period in rows:
        value = got[x]
        z = 730 / (alpha + period + 730)
        term, series = 1.0, 1.0
        for k in range(20000):  # plain, untransformed series of the paper
            term *= (r + x + k) * (b + x + k) / ((a + b + x - 1 + k) * (k + 1)) * z
            series += term
        growth = 1 - ((alpha + period) / (alpha + period + 730)) ** (r + x) * series
        odds = (a / (b + x - 1)) * ((alpha + period) / (alpha + t_x)) ** (r + x) if x else 0.0
        assert value == pytest.approx((a + b + x - 1) / (a - 1) * growth / (1 + odds), rel=1e-6)
