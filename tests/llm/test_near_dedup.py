"""MinHash near-dedup against all pairs of shingle sets."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from tallywise.llm import near_dedup


def brute(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets.setdefault(i, set()).update(zip(*(w[k:] for k in range(5)), strict=False) if len(w) >= 5 else [tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_same_components_as_all_pairs(docs):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choices(vocabulary, k=rng.choice([8, 40, 120, 300])) for _ in range(30)]
    shared = rng.choices(vocabulary, k=60)
    rows = []
    for _ in range(200):  # chains of copies around the limit, a large group of the first, a shared passage
        words = rng.choice(base if rng.random() < 0.5 else base[:1])
        text = edited(rng, words, rng.randrange(0, 1 + len(words) // 25))
        rows.append((len(rows), text.upper() if rng.random() < 0.1 else text))
        if rng.random() < 0.2:
            rows.append((len(rows), " ".join(rng.choices(vocabulary, k=150) + shared)))
    rng.shuffle(rows)
    got = near_dedup.link(docs(rows).repartition(7)).collect()
    expected = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_group_of_near_copies_across_pivots(docs):
    """Members that match some others of a group, but neither its pivots nor all of them."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 100])) for i in range(25)]  # neighbours overlap, distant ones don't
    got = {r.doc_id: r.component_id for r in near_dedup.link(docs(rows)).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()}
    assert set(got.values()) == {0}


def test_odd_rows(docs, odd, clashing):
    got = near_dedup.link(clashing(docs(odd)))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = got.collect()
    assert len(rows) == len(odd)
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i].n_shingles for i in (1, 2, 3, 4, 5, 6, 7)] == [0, 0, 0, 1, 1, 1, 1]
    assert [by_id[i].component_id for i in (1, 2, 3, 4, 7, 8)] == [1, 2, 3, 4, 7, 7]
    assert by_id[None].component_id is None and by_id[None].kept


def test_keep_one(docs, odd):
    kept = near_dedup.keep_one(docs(odd))
    assert kept.columns == docs(odd).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 6, 7, None, 9]))
    same = near_dedup.keep_one(docs([(3, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f")]))
    assert [r.doc_id for r in same.collect()] == [3]


def test_few_rows_have_to_be_joined_to_pick_ids(spark, docs, clashing):
    rows = [(i, f"text {i}") for i in range(-2000, 2000)] + [(None, "no id"), (7, "again")]
    ids = spark.createDataFrame([(i,) for i in [*range(0, 400, 2), 5000]], "doc_id long")
    wanted = {r.doc_id for r in ids.collect()}
    for table in (clashing(docs(rows)), docs(rows).withColumn("doc_id", F.col("doc_id").cast("int")).withColumn("word", F.lit("x"))):
        can, cannot = (part.collect() for part in near_dedup.told_apart(table, ids))
        assert Counter(can) + Counter(cannot) == Counter(table.collect())
        assert not wanted & {r.doc_id for r in cannot} and len(can) < 210
        picked, rest = near_dedup.among(table, ids), near_dedup.without(table, ids)
        assert picked.schema == rest.schema == table.schema
        assert Counter(picked.collect()) == Counter(r for r in table.collect() if r.doc_id in wanted)
        assert Counter(rest.collect()) == Counter(r for r in table.collect() if r.doc_id not in wanted)
    assert near_dedup.among(docs(rows), ids.where("false")).count() == 0


def test_empty(docs):
    assert near_dedup.link(docs([])).count() == 0
    assert near_dedup.keep_one(docs([])).count() == 0
