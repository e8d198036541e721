"""Sharding, mixing, top-k and chat formatting against plain Python on small inputs."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest

from tallywise.llm import chat_format, mixing, sharding, top_k


@pytest.mark.parametrize("n", [0, 5, 16, 203])
def test_shards_differ_by_one_at_most(docs, n, clashing):
    rows = [(i // 2, f"text é {i % 7}") for i in range(n)]
    got = sharding.shard(clashing(docs(rows)), 16).collect()
    per = Counter(r.shard for r in got)
    assert len(got) == n and all(n // 16 <= per[s] <= -(-n // 16) for s in range(16))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sizes_and_odd_rows(docs, odd):
    got = sharding.shard(docs(odd)).collect()
    expected = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == expected


def test_most_stay_at_home(docs):
    got = sharding.shard(docs([(i, "t") for i in range(3000)])).collect()
    assert sum(r.shard == r.home_shard for r in got) > 0.7 * len(got)


def test_walk_goes_clockwise():
    # Shard 0 owns arcs 0 and 2, shard 1 arc 1: what arc 0 has too many goes to arc 1.
    got = sharding.place([5, 0, 1], [0, 1, 0], 2)
    assert got == [(0, 0, 3, 0, 0), (0, 3, 5, 1, 0), (2, 0, 1, 1, 2)]


def test_mixing_weights_and_passes(docs):
    sizes = {"big": 4000, "mid": 800, "small": 300, None: 200}
    rows = [(k * 10_000 + i, "one two three", "en", s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    mixed = mixing.mix(docs(rows))
    got = Counter(r.source for r in mixed.select("source").collect())
    total = sum(sizes.values())
    share = {s: n / total for s, n in sizes.items()}

    def weights(a):
        z = sum(p**a for p in share.values())
        return {s: p**a / z for s, p in share.items()}

    low, high = 0.0, 1.0
    ratio = lambda a: max(weights(a)[s] / share[s] for s in share) / min(weights(a)[s] / share[s] for s in share)
    entropy = lambda a: -sum(w * math.log(w) for w in weights(a).values()) / math.log(len(share))
    for _ in range(60):
        a = (low + high) / 2
        low, high = (low, a) if entropy(a) <= mixing.ENTROPY and ratio(a) <= mixing.MAX_PASSES else (a, high)
    w = weights(high)
    budget = max(sizes[s] / w[s] for s in sizes)
    assert got["big"] == 4000 and all(got[s] == pytest.approx(w[s] * budget, abs=3) for s in sizes)
    assert got["small"] > 300
    passes = Counter((r.doc_id, r.mix_pass) for r in mixed.select("doc_id", "mix_pass").collect())
    assert max(passes.values()) == 1


def test_mixing_odd_rows(docs, odd, clashing):
    frame = clashing(docs(odd))
    got = mixing.mix(frame)
    assert set(frame.columns) <= set(got.columns) and got.count() >= len(odd)
    assert mixing.mix(docs([])).count() == 0
    assert mixing.mix(docs([(1, "a"), (1, "a")])).count() == 2


def test_top_k_with_ties_and_odd_vectors(spark):
    rows = [(i, [float(i % 3), 0.5, -0.25 * (i % 2)]) for i in range(40)]
    rows += [(100, None), (101, [1.0, None]), (102, [float("nan")]), (103, [float("inf"), 1.0]), (104, []), (105, [1.0, 2.0, 3.0, 4e9]), (0, rows[0][1]), (None, [1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = top_k.search(df.repartition(3), "vec_id % 5 = 0", k=4)
    used = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = []
    for q, v in dict(used).items():
        if q % 5 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in used if i != q)
            expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:4])]
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)
    assert top_k.search(df.limit(0), "vec_id % 5 = 0").count() == 0


def test_chat_round_trip(spark):
    wild = "a\\b <|turn|> \\<| [INST]</s> <\\|end|>\n<|end|>\\"
    turns = [(1, 0, "us\\er\nx", wild), (1, 1, "assistant", wild), (1, 2, "assistant", None), (1, 2, "assistant", None),
             (2, None, None, ""), (None, 5, "assistant", "é\U0001f600"), (3, 7, "assistant", "x" * 100_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = chat_format.read_back(chat_format.format_chats(df.withColumn("parts", chat_format.text_part(df.text))))
    by = defaultdict(list)
    for c, _, role, text in turns:
        by[c].append((role or "", text or ""))
    rows = {r.conv_id: r for r in got.collect()}
    assert {c: [tuple(t) for t in r.turns] for c, r in rows.items()} == dict(by)
    assert {c: r.loss_text for c, r in rows.items()} == {c: "".join(t for r, t in ts if r == "assistant") for c, ts in by.items()}
    assert hashlib.sha256(rows[3].loss_text.encode()).hexdigest()
    assert chat_format.format_chats(df.withColumn("parts", chat_format.text_part(df.text)).limit(0)).count() == 0


def test_parts_become_placeholders(spark):
    rows = [(1, 0, "user", [("text", "see", None, None), ("image", None, "a.png", 2)]),
            (1, 1, "assistant", [("text", "x", None, None), ("audio", None, "b.wav", 3), ("text", "y<|", None, None)]), (2, 0, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    assert got[1].formatted == "<|turn|>user\nsee<|image:0|><|end|><|turn|>assistant\nx<|audio:1|>y<\\|<|end|>"
    assert [tuple(a) for a in got[1].attachments] == [(0, "image", "a.png", 512), (1, "audio", "b.wav", 75)]
    assert got[1].loss_text == "xy<|" and got[1].expanded_tokens == 587 and got[2].formatted == "<|turn|>user\n<|end|>"
