"""Whitening of embeddings by shifted CholeskyQR.

Components are quantised to whole numbers, ``floor(scale * x) + shift``. The fit list
holds each distinct vector once; n and the sums per dimension are exact. With A the fit
list's rows less their mean:

1. a pass adds up the Gram matrix of the rows, per task in numpy, then entry by entry in
   Spark, so that d x d numbers reach the driver whatever the number of rows;
2. its Cholesky factor R1 (of the first pass after a small shift of the diagonal, which
   keeps it positive definite for any data) orthogonalises the rows: the next pass solves
   rows * R1^-1 column by column and adds up the Gram matrix of the result, and so on;
3. passes end when the Gram matrix is the identity to ``NEAR``, or when it no longer has
   a Cholesky factor, which happens if and only if the rows do not span all dimensions;
   one more pass would change nothing then, as nothing is left in those directions;
4. the factors are composed, R = Rk ... R2 R1, and the singular values s and right
   singular vectors of R give the components: eigenvalues s^2 / n of the covariance.

A last pass measures the covariance of the whitened fit list.

Rows are never written between passes: they are read again and solved anew, which takes
no disk and starts from whole numbers each time. All d x d work is on the driver; d is
the length of a vector, not a size of the data.

Vectors that are null or hold null or non-finite components, or one beyond what a whole
number of 52 bits holds, take no part, and neither do vectors of another length than most
(equally many: the longer). Rows of a null or repeated id are whitened like all others;
repeated vectors count once in the fit. Components whose eigenvalue is zero to double
precision are left out, so constant dimensions, fewer vectors than dimensions and a
single vector give fewer components or none. Equal eigenvalues have no order of their
own. ``deviation`` is null where a long cannot hold it. Extra columns are ignored,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Largest entry by which the last Gram matrix may miss the identity; the rest is made up for.
NEAR = 1e-10
#: Passes at most; three are enough for any full rank (shifted, then twice unshifted).
PASSES = 6
#: Rows that are solved at once.
ROWS = 4096
#: Rows whose sum surely fits a long.
SAFE = 512


def quantised(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vec_id, x``: the vectors that take part, as whole numbers."""
    df = pick(vectors, {"vec_id": "long", "embedding": "array<double>"}).where(f"""
        embedding IS NOT NULL AND size(embedding) > 0
        AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs({scale} * x) >= {1 << 52})
    """)
    lengths = df.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("rows"))
    usual = lengths.agg(F.max(F.struct("rows", "d"))["d"].alias("d")).scalar()
    return df.where(F.size("embedding") == usual).select(
        "vec_id", F.expr(f"transform(embedding, x -> CAST(floor({scale} * x) AS LONG) + {shift})").alias("x")
    )


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


@dataclass(frozen=True)
class Centre:
    """n and the sums of the fit list, of which the mean is taken without rounding it first."""

    n: int
    sums: tuple[int, ...]

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: whole parts are subtracted exactly."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - sums)^2 over the dimensions, exactly."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], object)
        far = float(np.abs(x - whole).max(initial=0)) + 1
        if (far * self.n) ** 2 * len(self.sums) < 2**62:
            part = (x - whole) * self.n - rest.astype(np.int64)
            return (part * part).sum(1).tolist()
        part = (x - whole).astype(object) * self.n - rest
        return [v if v < 2**63 else None for v in (part * part).sum(1).tolist()]


def solve_rows(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """rows * upper^-1 for an upper triangular matrix, column by column."""
    out = np.array(rows, order="F")
    for j in range(upper.shape[0]):
        if j:
            out[:, j] -= out[:, :j] @ upper[:j, j]
        out[:, j] /= upper[j, j]
    return out


def gram(fit: DataFrame, centre: Centre, factors: list[np.ndarray], project: np.ndarray | None = None) -> np.ndarray:
    """Gram matrix of the centred rows after solving by each factor, or after projection."""
    held = fit.sparkSession.sparkContext.broadcast((centre, factors, project))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, factors, project = held.value
        total = None
        for batch in batches:
            x = matrix(batch.column(0))
            for at in range(0, len(x), ROWS):
                rows = centre.rows(x[at : at + ROWS])
                for upper in factors:
                    rows = solve_rows(rows, upper)
                if project is not None:
                    rows = rows @ project
                part = rows.T @ rows
                total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"]
            )

    entries = fit.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    size = len(centre.sums) if project is None else project.shape[1]
    out = np.zeros((size, size))
    for e in entries:  # size * (size + 1) / 2 of them
        out[e.i, e.j] = out[e.j, e.i] = e.v
    return out


def totals(fit: DataFrame) -> Centre | None:
    """Number of rows and exact sums per dimension, or None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0, 0
        for batch in batches:
            x = matrix(batch.column(0))
            n += len(x)
            for at in range(0, len(x), SAFE):
                total = total + x[at : at + SAFE].sum(0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.array([str(v) for v in total]), pa.array([n] * len(total))],
                names=["i", "s", "n"],
            )

    rows = fit.select("x").mapInArrow(run, "i int, s string, n long").groupBy("i").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")
    ).collect()  # one row per dimension
    if not rows:
        return None
    return Centre(rows[0].n, tuple(int(r.s) for r in sorted(rows, key=lambda r: r.i)))


def first_shift(n: int, d: int, trace: float) -> float:
    """What is added to the diagonal of the first Gram matrix; for very many rows the bound is far from sharp."""
    return min(11 * np.finfo(float).eps * (n * d + d * (d + 1)), 1e-6) * trace


def beyond_rounding(s: np.ndarray, n: int) -> np.ndarray:
    """Which singular values are more than the rounding of sums in any order can leave.

    In a direction without rows the last Gram matrix holds some d units of rounding, of
    which composing takes the root, times the first factor's least entry, the shift's root.
    """
    d, unit = len(s), np.finfo(float).eps
    return s > max(s[0] * unit * max(n, d) ** 0.5 * d, (d * unit * first_shift(n, d, float((s**2).sum()))) ** 0.5)


def triangular(fit: DataFrame, centre: Centre) -> np.ndarray:
    """R with R'R equal to the Gram matrix of the centred rows, by shifted CholeskyQR."""
    d = len(centre.sums)
    factors: list[np.ndarray] = []
    for step in range(PASSES):
        g = gram(fit, centre, factors)
        if not g.any():
            return np.zeros((d, d))  # all rows are equal
        if step and np.abs(g - np.eye(d)).max() <= NEAR:
            break
        shift = 0.0 if step else first_shift(centre.n, d, np.trace(g))
        try:
            factors.append(np.linalg.cholesky(g + shift * np.eye(d)).T)
        except np.linalg.LinAlgError:
            break
    # What the last Gram matrix still differs from the identity: a square root exists whether it is singular or not.
    values, vectors = np.linalg.eigh(g)
    composed = np.sqrt(np.maximum(values, 0))[:, None] * vectors.T
    for upper in reversed(factors):
        composed = composed @ upper
    return composed


@dataclass(frozen=True)
class Whitening:
    """Mean, components (columns, by falling eigenvalue), eigenvalues, and what they explain."""

    centre: Centre
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.centre.rows(x) @ self.components / np.sqrt(self.eigenvalues)


def fit_whitening(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the distinct vectors in column ``x``; None if there is no component."""
    fit = Scratch(x.sparkSession, "whitening").save(x.select("x").distinct(), "fit")
    centre = totals(fit)
    if centre is None:
        return None
    _, s, v = np.linalg.svd(triangular(fit, centre))
    some = np.flatnonzero(beyond_rounding(s, centre.n))[:components]
    if not len(some):
        return None
    vectors, values = v[some].T, s[some] ** 2 / centre.n
    left = gram(fit, centre, [], vectors / np.sqrt(values)) / centre.n - np.eye(len(some))
    return Whitening(centre, vectors, values, values / ((s**2).sum() / centre.n), float(np.abs(left).max()))


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Per usable row and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    x = quantised(vectors, scale, shift)
    model = fit_whitening(x, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    held = vectors.sparkSession.sparkContext.broadcast(model)  # some vectors of d numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        k = len(model.eigenvalues)
        for batch in batches:
            rows = matrix(batch.column(1))
            white = model.rows(rows)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(rows)), k)))
            deviation = pa.array(model.centre.deviations(rows), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                 pa.array(np.full(len(ids), model.centre.n)), deviation.take(pa.array(np.repeat(np.arange(len(rows)), k))),
                 pa.array(white.ravel()), pa.array(np.tile(model.explained, len(rows))),
                 pa.array(np.full(len(ids), model.identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.mapInArrow(run, schema)
