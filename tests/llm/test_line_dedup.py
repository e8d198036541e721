"""Line dedup against plain dictionaries; the SQL counterpart is compared with the other queries."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tallywise.llm import line_dedup
from tallywise.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


def expected(rows, least=10):
    """(id, text, lines, dropped lines) per row."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= least:
                held.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if doc is None or len(held.get(key(x), ())) < 2 or min(held[key(x)]) == doc]
        out.append((doc, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=repr)


def test_query_equals_dictionaries(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    want = sorted((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, t, n, k in expected(rows))
    got = QUERIES["op13_line_dedup"](spark, SF_DIR)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted(map(tuple, got.collect())) == want and sum(w[2] for w in want)


@pytest.mark.parametrize("spread", [1, 16, 4096])
def test_random_lines_with_hot_ones(spark, docs, monkeypatch, spread):
    """One line is in every document; with a small spread its shard is copied."""
    monkeypatch.setattr(line_dedup, "SPREAD", spread)
    monkeypatch.setattr(line_dedup, "SHARDS", 3)
    rng = random.Random(spread)
    pool = [f"Line number {i} é\x1c" for i in range(60)] + ["short", " tiny\t", "日本語の文章です。ほら", "a b c d e f"]
    rows = []
    for doc in range(80):
        lines = [rng.choice(pool).swapcase() if rng.random() < 0.5 else f"  {rng.choice(pool)}\r" for _ in range(rng.randint(0, 9))]
        rows.append((doc * 3, "\n".join(["The line that everyone holds", *lines, ""])))
    assert rows_of(line_dedup.dedup_lines(docs(rows))) == expected(rows)


def test_odd_rows(spark, docs, odd, clashing):
    rows = [(r[0], r[1]) for r in odd] + [(8, "same text here now ok\nwith more lines"), (20, "no id\nlonger than ten"), (None, "longer than ten")]
    got = line_dedup.dedup_lines(clashing(docs(rows)))
    assert rows_of(got) == expected(rows)
    assert line_dedup.dedup_lines(docs([]).where("false")).collect() == []


def test_rows_of_one_id_are_one_document(spark, docs):
    rows = [(1, "only this id has it")] * 50 + [(1, f"the text number {i}\nonly this id has it") for i in range(50)]
    assert rows_of(line_dedup.dedup_lines(docs(rows))) == expected(rows)
    more = [*rows, (0, "x\nONLY this id has it ")]
    got = rows_of(line_dedup.dedup_lines(docs(more)))
    assert got == expected(more) and sum(r[3] for r in got) == 100


def test_copies_counts_rows(spark, docs):
    got = line_dedup.dedup_lines(docs([(i, "a line that four hold" if i < 4 else "a line that only one holds") for i in range(5)]))
    assert {r.doc_id: r.copies for r in got.collect()} == {0: 0, 1: 4, 2: 4, 3: 4, 4: 0}


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, (2, n), np.uint64)
    keys[0, : n // 2] = 7  # the other half decides
    index = line_dedup.PerfectHash.build(*keys)
    assert sorted(index.slots(*keys).tolist()) == list(range(n))


def test_shard_knows_its_own_lines_only():
    rng = np.random.default_rng(1)
    h1, h2 = rng.integers(0, 2**63, (2, 3000), np.uint64)
    counts, keepers = np.arange(2000), np.arange(2000) * 5
    shard = line_dedup.LineShard.load(*line_dedup.LineShard.build(h1[:2000], h2[:2000], counts, keepers).parts())
    slot = shard.probe(h1, h2)
    assert (slot[2000:] == -1).all()
    assert (shard.counts[slot[:2000]] == counts).all() and (shard.keepers[slot[:2000]] == keepers).all()
