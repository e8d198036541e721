"""Whitening against a plain eigendecomposition, and data that span few dimensions."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tallywise.llm import whitening
from tallywise.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>"


def expected(x, k=16):
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    c = fit - sums / n
    value, vector = np.linalg.eigh(c.T @ c / n)
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    return n, ((n * x - sums) ** 2).sum(1), (x - sums / n) @ vector / np.sqrt(value), value / np.trace(c.T @ c / n)


def check(rows, ids, x, k=16):
    n, deviation, white, explained = expected(x, k)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == len(ids) * white.shape[1]
    signs = None
    for i, vec in enumerate(ids):
        own = [got[vec, c + 1] for c in range(white.shape[1])]
        assert {(r.n, r.deviation) for r in own} == {(n, int(deviation[i]))}
        value = np.array([r.whitened for r in own])
        signs = np.sign(value * white[i]) if signs is None else signs  # one sign per component, the same for all rows
        assert value * signs == pytest.approx(white[i], abs=1e-8)
        assert [r.explained for r in own] == pytest.approx(explained, rel=1e-9)
    assert max(r.identity_error for r in rows) < 1e-10


def test_query_equals_an_eigendecomposition(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").toPandas()
    x = np.floor(64 * np.stack(table.embedding).astype(float)).astype(np.int64) + 1_000_000
    df = QUERIES["op12_embedding_whitening"](spark, SF_DIR)
    assert dict(df.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
        "whitened": "double", "explained": "double", "identity_error": "double"}
    check(df.collect(), table.vec_id.tolist(), x)


def test_spread_over_many_orders_of_magnitude(spark):
    """Scales from 1 to 10^-6 of the largest: a plain Gram matrix alone would lose the small ones."""
    rng = np.random.default_rng(4)
    values = rng.normal(size=(300, 5)) * np.array([1e8, 1e6, 1e4, 1e3, 1e2]) @ np.linalg.qr(rng.normal(size=(5, 5)))[0]
    x = np.floor(64 * values).astype(np.int64) + 1_000_000
    df = spark.createDataFrame(list(enumerate(values.tolist())), SCHEMA)
    rows = whitening.whiten(df).collect()
    n, sums = 300, x.sum(0)
    centred = (x - sums // n) - (sums % n) / n
    exact = np.linalg.svd(centred, compute_uv=False) ** 2
    got = {r.component: r.explained for r in rows}
    assert [got[c] for c in range(1, 6)] == pytest.approx(exact / exact.sum(), rel=1e-6)
    assert rows[0].identity_error < 1e-6 and len(rows) == 1500


def test_few_dimensions_spanned(spark):
    rng = np.random.default_rng(1)
    two = rng.normal(size=(40, 2))
    values = np.column_stack([two, np.full(40, 0.5), np.floor(64 * two[:, 0]) / 64])  # a constant and a copy
    df = spark.createDataFrame(list(enumerate(values.tolist())), SCHEMA)
    rows = whitening.whiten(df).collect()
    assert {r.component for r in rows} == {1, 2} and rows[0].identity_error < 1e-9
    assert sum({r.component: r.explained for r in rows}.values()) == pytest.approx(1)
    white = np.array([r.whitened for r in sorted(rows, key=lambda r: (r.component, r.vec_id))]).reshape(2, -1)
    assert white @ white.T / 40 == pytest.approx(np.eye(2), abs=1e-9)


def test_odd_rows(spark, clashing):
    nan, inf = math.nan, math.inf
    good = [(1, [0.1, 0.9]), (1, [0.4, 0.2]), (None, [0.7, 0.7]), (4, [0.1, 0.9]), (5, [0.31, 0.05])]
    odd = [(6, None), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, []), (11, [1.0]), (12, [1e300, 0.0])]
    df = clashing(spark.createDataFrame(good + odd, SCHEMA))
    rows = whitening.whiten(df).collect()
    assert sorted(str(r.vec_id) for r in rows) == sorted(str(v) for v, _ in good for _ in range(2))
    assert {r.n for r in rows} == {4}  # rows 1 and 4 hold the same vector


def test_no_component(spark):
    empty = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and "identity_error" in empty.columns
    same = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(9)], SCHEMA)
    assert whitening.whiten(same).collect() == []


def test_deviation_is_exact_or_null():
    centre = whitening.Centre(3, (7, 2**50))
    x = np.array([[1, 2], [2**40, 5], [-(2**31), 2**31]])
    want = [sum((3 * int(v) - s) ** 2 for v, s in zip(row, centre.sums, strict=True)) for row in x]
    assert centre.deviations(x) == [w if w < 2**63 else None for w in want]


def test_solving_rows():
    rng = np.random.default_rng(0)
    upper = np.triu(rng.normal(size=(6, 6))) + 3 * np.eye(6)
    rows = rng.normal(size=(50, 6))
    assert whitening.solve_rows(rows, upper) @ upper == pytest.approx(rows)


@pytest.mark.parametrize(("n", "d", "rank"), [(40, 4, 2), (400, 8, 3), (200, 64, 10)])
def test_rank_does_not_depend_on_the_order_of_sums(monkeypatch, n, d, rank):
    rng = np.random.default_rng(n)

    def gram(fit, centre, factors, project=None):
        total = 0
        for rows in np.array_split(rng.permutation(fit), 4):
            rows = centre.rows(rows)
            for upper in factors:
                rows = whitening.solve_rows(rows, upper)
            total = total + rows.T @ rows
        return total

    monkeypatch.setattr(whitening, "gram", gram)
    for _ in range(40):
        fit = rng.integers(-200, 200, (n, rank)) @ rng.integers(-2, 3, (rank, d)) + 1_000_000
        centre = whitening.Centre(n, tuple(int(x) for x in fit.sum(0)))
        s = np.linalg.svd(whitening.triangular(fit, centre), compute_uv=False)
        assert whitening.beyond_rounding(s, n).sum() == np.linalg.matrix_rank(fit - fit.mean(0), tol=1)
