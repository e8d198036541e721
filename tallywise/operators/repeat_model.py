"""Repeat-purchase model of Fader, Hardie and Lee (2005) as Spark jobs.

A person is described by x repeat orders, the days t_x between first and last
order and the days T since the first one. Persons with equal (x, t_x, T) are
one weighted row, so the work does not grow with the number of persons.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from ..params import DAYS_PER_YEAR, HORIZON_YEARS, MODEL_PENALTY
from ..functions.values import exact_mean, round_even
from ..functions.order_stats import Quantile, quantiles

PARAMETERS = ("r", "alpha", "a", "b")
HISTORY = ("frequency", "recency", "T")
_PAIRS = tuple(combinations_with_replacement(PARAMETERS, 2))
HORIZON_DAYS = float(HORIZON_YEARS * DAYS_PER_YEAR)

# Coefficients of Stirling's series for the log-gamma function.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
_SHIFT = 8

# The fit ends where the slopes in logs of the parameters are this flat, or where the
# objective can no longer be told to grow, if they are nearly so there.
FLAT, NEARLY_FLAT = 1e-9, 1e-6
# Longest step in logs.
STRIDE = 2.0
# A mean chance to leave below this is none: the fit was on its way to 0.
NOBODY = 1e-6


def repeat_histories(rfm: DataFrame) -> DataFrame:
    """Model inputs per person; a person first seen on the last day has none."""
    return rfm.select(
        "customer_unique_id",
        (F.col("total_orders") - 1).alias("frequency"),
        F.col("customer_tenure_days").alias("recency"),
        (F.col("recency_days") + F.col("customer_tenure_days")).alias("T"),
    ).filter(F.col("T") > 0)


def distinct_histories(histories: DataFrame) -> DataFrame:
    """Equal histories as one weighted row.

    Few bytes but much arithmetic follow per row, so they are spread over all
    cores instead of being merged into partitions by size.
    """
    cores = histories.sparkSession.sparkContext.defaultParallelism
    counted = histories.groupBy(*HISTORY).agg(F.count(F.lit(1)).alias("customers"))
    return counted.repartition(cores, F.xxhash64(*HISTORY))


def ln_gamma(z: Column) -> Column:
    """Log-gamma for z > 0: Stirling's series at z + 8, stepped back down."""
    w = z + F.lit(float(_SHIFT))
    inverse = 1 / w
    series = F.lit(_STIRLING[-1])
    for c in reversed(_STIRLING[:-1]):
        series = series * inverse * inverse + F.lit(c)
    steps = z
    for k in range(1, _SHIFT):
        steps = steps * (z + F.lit(float(k)))
    return (
        (w - 0.5) * F.log(w) - w + F.lit(0.5 * math.log(2 * math.pi))
        + series * inverse - F.log(steps)
    )


Number = Column | float


def _series(inverse: Number, coefficients: Sequence[float]) -> Number:
    """Sum of c_k * inverse^(2k), k from 0 on."""
    total: Number = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        total = total * inverse * inverse + c
    return total


def digamma(z: Number, log: Callable[[Number], Number] = F.log) -> Number:
    """Slope of log-gamma for z > 0, of columns or (with ``math.log``) of numbers."""
    inverse = 1 / (z + float(_SHIFT))
    slopes = [-(2 * k + 1) * c for k, c in enumerate(_STIRLING)]
    back: Number = 1 / z
    for k in range(1, _SHIFT):
        back = back + 1 / (z + float(k))
    return log(z + float(_SHIFT)) - inverse / 2 + inverse * inverse * _series(inverse, slopes) - back


def trigamma(z: Number) -> Number:
    """Slope of digamma for z > 0, of columns or numbers."""
    inverse = 1 / (z + float(_SHIFT))
    bends = [(2 * k + 1) * (2 * k + 2) * c for k, c in enumerate(_STIRLING)]
    back: Number = 1 / (z * z)
    for k in range(1, _SHIFT):
        back = back + 1 / ((z + float(k)) * (z + float(k)))
    return inverse + inverse * inverse / 2 + inverse * inverse * inverse * _series(inverse, bends) + back


def log_likelihood() -> Column:
    """Log-likelihood of one history at the parameters beside it.

    ``constant`` holds the terms that depend on the parameters alone.
    """
    r, alpha, a, b, constant = (F.col(c) for c in (*PARAMETERS, "constant"))
    x, t_x, period = (F.col(c).cast("double") for c in HISTORY)
    counts = ln_gamma(r + x) + ln_gamma(b + x) - ln_gamma(a + b + x)
    alive = -(r + x) * F.log(alpha + period)
    gone = F.log(a / (b + F.greatest(x, F.lit(1.0)) - 1)) - (r + x) * F.log(alpha + t_x)
    # ln(e^alive + e^gone) without leaving the range of doubles.
    both = F.greatest(alive, gone) + F.log1p(F.exp(-F.abs(gone - alive)))
    return constant + counts + F.when(x > 0, both).otherwise(alive)


def _constant(cell: Mapping[str, float]) -> float:
    r, alpha, a, b = (cell[p] for p in PARAMETERS)
    return r * math.log(alpha) - math.lgamma(r) + math.lgamma(a + b) - math.lgamma(b)


def grid_log_likelihood(
    histories: DataFrame, cells: Sequence[Mapping[str, float]]
) -> DataFrame:
    """Log-likelihood of the data at each parameter cell.

    The cells ride along inside each history row and are summed before the
    shuffle, which carries one row per cell and task.
    """
    grid = "array({})".format(", ".join(
        "struct({} as cell, {}, {!r}D as constant)".format(
            i, ", ".join(f"{float(c[p])!r}D as {p}" for p in PARAMETERS), _constant(c)
        )
        for i, c in enumerate(cells)
    ))
    spread = histories.select(*HISTORY, "customers", F.expr(f"inline({grid})"))
    return spread.groupBy("cell", *PARAMETERS).agg(
        F.sum(F.col("customers") * log_likelihood()).alias("log_likelihood"),
        F.sum("customers").alias("customers"),
    )


@dataclass(frozen=True)
class Surface:
    """Mean log-likelihood at one point with its slopes and curvature in the parameters."""

    value: float
    slopes: np.ndarray
    curvature: np.ndarray


class Likelihood:
    """Mean log-likelihood of distinct histories as a function of the parameters.

    The expressions name the parameters as columns and are built once; a point comes as
    a row, so that all points run the same compiled code.
    """

    def __init__(self, histories: DataFrame):
        self.spark = histories.sparkSession
        x, t_x, period = (F.col(c).cast("double") for c in HISTORY)
        r, alpha, a, b = (F.col(p) for p in PARAMETERS)
        self.histories = histories.select("customers", x.alias("x"), t_x.alias("t_x"), period.alias("T"))
        x, ends, lasts = F.col("x"), alpha + F.col("T"), alpha + F.col("t_x")
        passed = b + F.greatest(x, F.lit(1.0)) - 1
        self.steps: list[dict[str, Column]] = [
            {
                "orders": r + x, "b_x": b + x, "ab_x": a + b + x, "log_end": F.log(ends), "log_last": F.log(lasts),
                "end": 1 / ends, "last": 1 / lasts, "step": 1 / passed, "log_step": F.col("log_a") - F.log(passed),
            },
            {
                "alive": -F.col("orders") * F.col("log_end"),
                "gone": F.col("log_step") - F.col("orders") * F.col("log_last"),
                "fall": digamma(F.col("ab_x")), "bent": -trigamma(F.col("ab_x")),
            },
            {
                # Probability that the person is gone, given the history.
                "w": F.when(x > 0, 1 / (1 + F.exp(F.col("alive") - F.col("gone")))).otherwise(0.0),
                # ln(e^alive + e^gone) without leaving the range of doubles.
                "mixed": F.when(
                    x > 0, F.greatest("alive", "gone") + F.log1p(F.exp(-F.abs(F.col("gone") - F.col("alive"))))
                ).otherwise(F.col("alive")),
            },
            {
                "u": 1 - F.col("w"), "d_r": F.col("log_last") - F.col("log_end"),
                "d_alpha": F.col("orders") * (F.col("last") - F.col("end")),
            },
        ]
        w, u, orders, end, last, step, fall, bent, b_x = (
            F.col(c) for c in ("w", "u", "orders", "end", "last", "step", "fall", "bent", "b_x"))
        d = {"r": F.col("d_r"), "alpha": F.col("d_alpha"), "a": -1 / a, "b": step}
        terms: dict[str, Column] = {
            "value": ln_gamma(orders) + ln_gamma(b_x) - ln_gamma(F.col("ab_x")) + F.col("mixed"),
            "r": digamma(orders) - u * F.col("log_end") - w * F.col("log_last"),
            "alpha": -orders * (u * end + w * last),
            "a": w / a - fall,
            "b": digamma(b_x) - fall - w * step,
        }
        own = {
            ("r", "r"): trigamma(orders), ("r", "alpha"): -(u * end + w * last),
            ("alpha", "alpha"): orders * (u * end * end + w * last * last),
            ("a", "a"): bent - w / (a * a), ("a", "b"): bent,
            ("b", "b"): bent + trigamma(b_x) + w * step * step,
        }
        for p, q in _PAIRS:
            terms[f"{p}_{q}"] = own.get((p, q), F.lit(0.0)) + w * u * d[p] * d[q]
        self.sums = [F.sum("customers").alias("customers")] + [
            F.sum(F.col("customers") * t).alias(name) for name, t in terms.items()
        ]

    def at(self, params: Mapping[str, float]) -> Surface | None:
        """Value and derivatives from one aggregation, of which one row comes back; None without histories."""
        r, alpha, a, b = (float(params[p]) for p in PARAMETERS)
        point = self.spark.createDataFrame(
            [(r, alpha, a, b, math.log(a))], "r double, alpha double, a double, b double, log_a double"
        )
        rows = self.histories.crossJoin(F.broadcast(point))
        for step in self.steps:
            rows = rows.withColumns(step)
        total = rows.agg(*self.sums).first().asDict()
        customers = total.pop("customers")
        if not customers:
            return None
        mean = {name: value / customers for name, value in total.items()}
        psi = lambda z: digamma(z, math.log)
        alone = {
            "r": math.log(alpha) - psi(r), "alpha": r / alpha, "a": psi(a + b), "b": psi(a + b) - psi(b),
            "r_r": -trigamma(r), "r_alpha": 1 / alpha, "alpha_alpha": -r / alpha**2,
            "a_a": trigamma(a + b), "a_b": trigamma(a + b), "b_b": trigamma(a + b) - trigamma(b),
        }
        curvature = np.zeros((4, 4))
        for p, q in _PAIRS:
            i, j = PARAMETERS.index(p), PARAMETERS.index(q)
            curvature[i, j] = curvature[j, i] = mean[f"{p}_{q}"] + alone.get(f"{p}_{q}", 0.0)
        return Surface(
            float(mean["value"] + _constant(params)), np.array([mean[p] + alone[p] for p in PARAMETERS]), curvature
        )


_FIT_FIELDS = {
    **dict.fromkeys(PARAMETERS, "double"), "converged": "boolean", "rounds": "int", "mean_log_likelihood": "double",
    "objective": "double",
}


@dataclass(frozen=True)
class RepeatModel:
    """Fitted parameters; ``converged`` is False when they must not be used.

    ``objective`` is the mean log-likelihood less the penalty, ``slopes`` are its slopes in
    the logs of the parameters, ``rounds`` the jobs it took.
    """

    r: float
    alpha: float
    a: float
    b: float
    converged: bool
    rounds: int = 0
    mean_log_likelihood: float = math.nan
    objective: float = math.nan
    slopes: tuple[float, ...] = (math.nan,) * 4

    def params(self) -> dict[str, float]:
        return {p: getattr(self, p) for p in PARAMETERS}

    def as_row(self, spark: SparkSession) -> DataFrame:
        values = (*(getattr(self, f) for f in _FIT_FIELDS), *self.slopes)
        names = ", ".join([*(f"{f} {t}" for f, t in _FIT_FIELDS.items()), *(f"slope_{p} double" for p in PARAMETERS)])
        return spark.createDataFrame([values], names)

    @classmethod
    def from_row(cls, row: Row) -> RepeatModel:
        return cls(
            **{f: row[f] for f in _FIT_FIELDS}, slopes=tuple(row[f"slope_{p}"] for p in PARAMETERS)
        )


def fit(histories: DataFrame, penalty: float = MODEL_PENALTY) -> RepeatModel:
    """Maximise the penalised mean log-likelihood by damped Newton steps in logs.

    Each round is one job over the distinct histories. The penalty sees alpha in
    units of a tenth of the longest period. A step goes uphill whatever the curvature
    (its eigenvalues count by size), is halved until the objective grows enough, and is
    at most ``STRIDE`` long. The best a or b may be 0, where nobody or everybody stays: there
    the slope in logs falls with the parameter itself, so the fit ends at a tiny value, and
    a becomes 0 where the mean chance to leave is below ``NOBODY``.
    Only a point that is neither flat nor can be improved is no convergence.
    """
    longest = histories.agg(F.max("T")).first()[0]
    if longest is None:
        return RepeatModel(1.0, 1.0, 1.0, 1.0, converged=False)
    units = np.array([1.0, 10.0 / longest, 1.0, 1.0])
    likelihood = Likelihood(histories)
    rounds = 0

    def natural(point: np.ndarray) -> dict[str, float]:
        return dict(zip(PARAMETERS, (np.exp(point) / units).tolist(), strict=True))

    def objective(point: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float] | None:
        nonlocal rounds
        rounds += 1
        params = natural(point)
        at = likelihood.at(params)
        values = np.array([params[p] for p in PARAMETERS])
        size = 2 * penalty * np.exp(2 * point)
        value = float(at.value - size.sum() / 2)
        slopes = values * at.slopes - size
        curvature = np.outer(values, values) * at.curvature + np.diag(values * at.slopes - 2 * size)
        if not (math.isfinite(value) and np.isfinite(slopes).all() and np.isfinite(curvature).all()):
            return None
        return value, slopes, curvature, at.value

    point = np.zeros(4)
    now = objective(point)
    while now is not None:
        value, slopes, curvature, plain = now
        found = RepeatModel(
            **natural(point), converged=True, rounds=rounds, mean_log_likelihood=plain, objective=value,
            slopes=tuple(slopes.tolist())
        )
        if found.a / (found.a + found.b) < NOBODY:
            found = replace(found, a=0.0)
        if np.abs(slopes).max() <= FLAT:
            return found
        bends, axes = np.linalg.eigh(curvature)
        bends = np.maximum(np.abs(bends), np.abs(bends).max() * 1e-13)
        step = axes @ (axes.T @ slopes / bends)
        step *= min(1.0, STRIDE / np.abs(step).max())
        steep = float(np.abs(slopes).max())
        part, after = 1.0, None
        while part > (0.2 if steep <= NEARLY_FLAT else 1e-9):
            after = objective(point + part * step)
            if after is not None and (
                after[0] >= value + 1e-4 * part * float(slopes @ step)
                # So near the top doubles tell slopes apart, but no heights.
                or steep <= NEARLY_FLAT and 2 * np.abs(after[1]).max() <= steep
            ):
                break
            part, after = part / 2, None
        if after is None:
            return replace(found, converged=steep <= NEARLY_FLAT, rounds=rounds)
        point, now = point + part * step, after
    return RepeatModel(**natural(point), converged=False, rounds=rounds)


def prob_alive(params: Mapping[str, float]) -> Column:
    """Probability that a person still buys; null without an observation period."""
    r, alpha, a, b = (F.lit(float(params[p])) for p in PARAMETERS)
    x, t_x, period = (F.col(c).cast("double") for c in HISTORY)
    if not params["a"]:
        return F.when(period > 0, 1.0)
    odds = (r + x) * F.log((alpha + period) / (alpha + t_x)) + F.log(
        a / (b + F.greatest(x, F.lit(1.0)) - 1)
    )
    return F.when(period > 0, F.when(x == 0, 1.0).otherwise(1 / (1 + F.exp(odds))))


def add_prob_alive(rfm: DataFrame, params: Mapping[str, float]) -> DataFrame:
    """Segmented persons with ``prob_alive``: a projection, nothing is joined."""
    return (
        rfm.withColumn("frequency", F.col("total_orders") - 1)
        .withColumn("recency", F.col("customer_tenure_days"))
        .withColumn("T", F.col("recency_days") + F.col("customer_tenure_days"))
        .withColumn("prob_alive", prob_alive(params))
        .drop(*HISTORY)
    )


def _quadrature(a: float) -> list[tuple[float, float, float]]:
    """(log p, log(1 - p), log weight) of nodes for densities over 0 < p < 1.

    p runs along the logistic curve of pi * sinh(u), which makes ends of any power
    harmless; u is spaced finely enough for the narrowest peak in log p, of width 1 / sqrt(a).
    """
    width = 1 / (64 * max(1.0, math.sqrt(a)))
    nodes = []
    for k in range(-math.ceil(3.5 / width), math.ceil(3.5 / width) + 1):
        bend = math.pi * math.sinh(k * width)
        log_p, log_q = -math.log1p(math.exp(-bend)), -math.log1p(math.exp(bend))
        nodes.append((log_p, log_q, math.log(width * math.pi * math.cosh(k * width))))
    return nodes


def expected_orders(
    histories: DataFrame, params: Mapping[str, float], days: float = HORIZON_DAYS
) -> DataFrame:
    """Distinct histories with ``expected``, the orders to come in the next ``days``.

    With p the chance to leave after an order, p is Beta(a, b + x) among those still
    there and a person of known p orders g(p) = (1 - (1 + p s)^-(r + x)) / p times, s =
    days / (alpha + T). The mean of g is that of the line through g(0) and g(1), known
    exactly, plus that of what is left, which vanishes at both ends and is summed over
    fixed nodes. So the work is the same for every history and horizon, where the
    series of the paper needs ever more terms as s grows. The nodes ride along inside
    each history's row and are summed before the shuffle.
    """
    r, alpha, a, b = (float(params[p]) for p in PARAMETERS)
    x, t_x, period = (F.col(c).cast("double") for c in HISTORY)
    s = F.lit(float(days)) / (F.lit(alpha) + period)
    if not a:  # nobody leaves
        return histories.select(*HISTORY, "customers", ((F.lit(r) + x) * s).alias("expected"))
    scale = F.lit(-math.lgamma(a)) + ln_gamma(F.lit(a + b) + x) - ln_gamma(F.lit(b) + x)
    orders = F.col("orders")
    prepared = histories.select(*HISTORY, "customers", (F.lit(r) + x).alias("orders"), (F.lit(b) + x).alias("beta"), s.alias("s"), scale.alias("scale"))
    prepared = prepared.withColumns({
        "at_0": orders * F.col("s"), "at_1": -F.expm1(-orders * F.log1p(F.col("s"))),
    })
    nodes = F.inline(F.array(*(
        F.struct(
            F.lit(math.exp(log_p)).alias("p"), F.lit(math.exp(log_q)).alias("q"),
            F.lit(a * log_p + weight).alias("left"), F.lit(log_q).alias("log_q"),
        )
        for log_p, log_q, weight in _quadrature(a)
    )))
    g = -F.expm1(-orders * F.log1p(F.col("p") * F.col("s"))) / F.col("p")
    rest = g - F.col("q") * F.col("at_0") - F.col("p") * F.col("at_1")
    density = F.exp(F.col("scale") + F.col("left") + F.col("beta") * F.col("log_q"))
    line = (F.col("beta") * F.col("at_0") + F.lit(a) * F.col("at_1")) / (F.col("beta") + F.lit(a))
    odds = F.when(
        x > 0,
        F.exp((r + x) * F.log((alpha + period) / (alpha + t_x)) + F.log(a / (b + x - 1))),
    ).otherwise(0.0)
    summed = prepared.select("*", nodes).groupBy(*HISTORY, "customers").agg(
        F.sum(density * rest).alias("rest"), F.first(line).alias("line")
    )
    return summed.select(*HISTORY, "customers", ((F.col("line") + F.col("rest")) / (1 + odds)).alias("expected"))


def forecast_histories(histories: DataFrame, params: Mapping[str, float]) -> DataFrame:
    """Distinct histories with P(alive) and expected orders, to six places."""
    return expected_orders(histories, params).select(
        *HISTORY,
        "customers",
        round_even(prob_alive(params), 6).alias("prob_alive"),
        round_even(F.col("expected"), 6).alias("expected_purchases"),
    )


def forecast(rfm: DataFrame, params: Mapping[str, float], histories: DataFrame | None = None) -> DataFrame:
    """P(alive) and expected orders of every person; null where the model knows nothing.

    Equal histories are forecast once and looked up; ``histories`` are the distinct ones
    where they are at hand.
    """
    persons = rfm.select(
        "customer_unique_id", "rfm_segment",
        (F.col("total_orders") - 1).alias("frequency"),
        F.col("customer_tenure_days").alias("recency"),
        (F.col("recency_days") + F.col("customer_tenure_days")).alias("T"),
    )
    if histories is None:
        histories = distinct_histories(repeat_histories(rfm))
    known = forecast_histories(histories, params).drop("customers")
    return persons.join(known, list(HISTORY), "left").select(
        "customer_unique_id", "rfm_segment", *HISTORY, "prob_alive", "expected_purchases"
    )


def forecast_stats(persons: DataFrame) -> DataFrame:
    """Median, mean and maximum forecast and the median P(alive) over persons with one."""
    middle = quantiles(
        persons, [], [Quantile("median_expected", "expected_purchases"), Quantile("median_alive", "prob_alive")]
    )
    spread = persons.agg(
        round_even(exact_mean(F.col("expected_purchases"), 10), 4).alias("mean_expected"),
        round_even(F.max("expected_purchases"), 4).alias("max_expected"),
    )
    return spread.crossJoin(F.broadcast(middle)).select(
        round_even(F.col("median_expected"), 4).alias("median_expected"),
        "mean_expected",
        "max_expected",
        round_even(F.col("median_alive"), 4).alias("median_prob_alive"),
    )
