from __future__ import annotations

import numpy as np
import pytest

from tallywise.llm import top_k

SCHEMA = "vec_id long, embedding array<double>"


def brute(queries, rows, k):
    """(query id, rank, id, score) of the k best; vectors are lists of integers."""
    found = {}
    for q, v in queries:
        for i, w in rows:
            if i != q:
                found.setdefault(q, []).append((-sum(a * b for a, b in zip(v, w, strict=False)), i))
    return sorted((q, n + 1, i, -s) for q, best in found.items() for n, (s, i) in enumerate(sorted(best)[:k]))


def vectors(rng, n, high, some=1.0):
    out = []
    for _ in range(n):
        v = rng.integers(-high, high + 1, rng.integers(0, 12))
        out.append([int(x) if rng.random() < some else 0 for x in v])
    return out


def test_nothing_is_broadcast_at_any_threshold(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(200, 8)).tolist())], SCHEMA)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        got = top_k.search(df, "vec_id % 5 = 0", k=3)
        assert got.count() == 120
        assert "Broadcast" not in got._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("high", [3, 10_000, 10**9])
def test_many_blocks_tiles_and_parts(spark, monkeypatch, high):
    for name, value in (("BLOCK", 7), ("QUERIES", 3), ("TILE", 300), ("PART", 900)):
        monkeypatch.setattr(top_k, name, value)
    rng = np.random.default_rng(high)
    rows = [(int(i), v) for i, v in zip(rng.integers(0, 60, 120), vectors(rng, 120, high), strict=True)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], SCHEMA).repartition(3)
    got = top_k.search(df, "vec_id % 4 = 0", k=4, scale=1)
    once = {(i, tuple(v)) for i, v in rows if i % 4 == 0}
    assert sorted(tuple(r) for r in got.collect()) == brute(once, rows, 4)


@pytest.mark.parametrize(("high", "some"), [(1, 1.0), (90, 0.05), (10_000, 0.5), (10**9, 0.1), (0, 1.0)])
def test_block_meets_block(high, some):
    rng = np.random.default_rng(high + 1)

    def block(ids):
        rows = list(zip(ids, vectors(rng, len(ids), high, some), strict=True))
        return rows, [
            np.array(ids, np.int64), top_k._narrow(np.array([x for _, v in rows for x in v], np.int64)),
            np.array([len(v) for _, v in rows], np.int32),
        ]

    queries, packed = block(list(range(0, 40, 2)))
    best, rows = top_k.Best(top_k.Postings(*packed), 5), []
    for size in (3, 50, 1, 400):
        some_rows, packed = block([int(x) for x in rng.integers(0, 900, size)])
        best.meet(top_k.Candidates(*packed))
        rows += some_rows
    got = {}
    for q, i, s in zip(*best.rows(), strict=True):
        got.setdefault(int(q), []).append((-int(s), int(i)))
    assert sorted((q, n + 1, i, -s) for q, x in got.items() for n, (s, i) in enumerate(sorted(x))) == brute(queries, rows, 5)


def test_blocks_are_closed_by_their_components_too(spark):
    df = spark.createDataFrame([(i, [1] * (4 if i else 100)) for i in range(20)], "vec_id long, terms array<long>")
    sizes = [
        len(r.terms) // r.width
        for r in df.coalesce(1).mapInArrow(
            top_k._blocks(2048, 30), "no long, width int, ids binary, terms binary, lengths binary"
        ).collect()
    ]
    assert sum(sizes) == 176 and sorted(sizes)[-2] < 60 and max(sizes) == 100
