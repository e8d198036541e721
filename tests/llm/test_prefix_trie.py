"""The prefix trie against one built in memory, and its parts against plain loops."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallywise.llm import order, prefix_trie
from tallywise.llm.common import Scratch
from tallywise.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string"
SF_DIR = "/root/testdata/sf0.001"


def rebuilt(rows):
    """Conversations with shared heads, from rows in the order of their turns."""
    own = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        own[conv].append((role or "", text or ""))
    own.pop(None, None)
    out = {}
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 6
        out[conv] = (*own.get(conv - conv % 100, [])[:h], *own[conv][h:])
    return out


def trie(conversations):
    members, children = defaultdict(list), defaultdict(list)
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, rows = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        saved[node] = own + sum(saved[c] for c in children[node])
        ends = sorted(c for c in members[node] if len(conversations[c]) == len(node))
        rows[min(members[node]), len(node)] = (
            min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), leaves[node],
            saved[node], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return rows


def rows_of(df):
    rows = df.collect()
    found = {(r.conv_id, r.depth): (
        r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query_equals_a_trie_in_memory(spark):
    rows = spark.read.parquet(f"{SF_DIR}/conversations.parquet").collect()
    got = QUERIES["op11_prefix_trie"](spark, SF_DIR)
    assert got.columns == [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for c, t in got.dtypes if c != "ends_sha256"} == {"bigint"}
    assert rows_of(got) == trie(rebuilt([tuple(r) for r in rows]))


def test_shared_turns_nulls_and_turnless_conversations(spark, clashing, monkeypatch):
    rng = random.Random(5)
    rows = []
    for conv in rng.sample(range(400), 90):
        for turn in range(rng.randint(1, 5)):
            role, text = rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "long " * 200])
            rows.append((conv, turn if turn or rng.random() < 0.8 else None, role, text))
    rows += [(7000, t, "user", "same") for t in range(300)]  # one conversation of many turns
    rows += [(None, 0, "user", "no conversation")]
    df = clashing(spark.createDataFrame(rows, TURNS))
    monkeypatch.setattr(order, "BLOCK", 16)
    monkeypatch.setattr(prefix_trie, "PORTION", 3)
    want = trie(rebuilt(rows))
    got = rows_of(prefix_trie.build_trie(*prefix_trie.rebuild(df), limit=40))
    assert got == want
    assert any(r[0] is None and r[5] != hashlib.sha256(b"").hexdigest() for r in got.values())  # turnless members


def test_one_chain_many_copies_and_equal_turns(spark):
    """A third of all rows in one conversation, all others equal; repeated rows are turns."""
    rows = [(1, 0, "user", "again")] * 60 + [(c, t, "user", f"t{t}") for c in range(2, 42) for t in range(3)]
    got = rows_of(prefix_trie.build_trie(spark.createDataFrame(rows, TURNS), limit=20))
    own = defaultdict(list)
    for c, _, role, text in rows:
        own[c].append((role, text))
    assert got == trie({c: tuple(t) for c, t in own.items()})


def test_empty_table_and_one_turnless_conversation(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.build_trie(*prefix_trie.rebuild(empty)).collect() == []
    only = spark.createDataFrame([(5,)], "conv_id long")
    assert rows_of(prefix_trie.build_trie(empty, only)) == trie({5: ()})


@pytest.mark.parametrize("how", ["sum", "bit_xor"])
def test_running_totals(spark, monkeypatch, how):
    monkeypatch.setattr(order, "BLOCK", 4)
    values = [random.Random(2).randint(-99, 99) for _ in range(1)] + list(range(-40, 59))
    df = spark.createDataFrame(list(enumerate(values)), "place long, v long").repartition(7)
    got = order.running(Scratch(spark, "t"), df, "place", ["v"], len(values), how).orderBy("place").collect()
    total = 0
    for row, v in zip(got, values, strict=True):
        total = total + v if how == "sum" else total ^ v
        assert row.running_v == total


def test_list_ranks_of_a_shuffled_list(spark):
    ids = random.Random(3).sample(range(10_000), 700)
    links = spark.createDataFrame(list(zip(ids, [*ids[1:], None], strict=True)), "arc long, next long")
    places, size = order.list_ranks(Scratch(spark, "t"), links, limit=50)
    assert size == 700 and {r.arc: r.place for r in places.collect()} == {a: i for i, a in enumerate(ids)}


def test_ranks_put_nulls_first_and_split_nothing(spark):
    values = [None, None, 3, 1, 2, 2, None]
    df = spark.createDataFrame([(v,) for v in values], "v long").withColumn("row", F.monotonically_increasing_id())
    got = sorted(order.ranked(Scratch(spark, "t"), df, ("v", "row"), "place").collect(), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(7)) and [r.v for r in got] == [None] * 3 + [1, 2, 2, 3]
