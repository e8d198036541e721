"""Packing: round trip of the tokens, full bins, and plain counting for the plan."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tallywise.llm import packing


def plain_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary_path()).encode(text or "", add_special_tokens=False).ids + [0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aBé漢'sl1.,\n\t\x0b\x1c\x85 ́ <|endoftext|>® "), max_size=40), max_size=5))
def test_words_have_the_tokens_of_the_whole_text(texts):
    tokens = packing.WordTokens(packing.vocabulary_path())
    got = [
        ids[a:b].tolist() for ids, edges in tokens.in_portions(pa.array(texts, pa.string()))
        for a, b in itertools.pairwise(edges.tolist())
    ]
    assert got == [plain_ids(t) for t in texts]


def test_words_that_differ_in_capitals_and_marks_are_tokenised_once():
    letters = [chr(c) for c in range(0x100) if chr(c).isalpha()]
    marks = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()]
    forms = [f("tokeniser") + m for f in (str, str.upper, str.capitalize) for m in ["", *marks, "<|", "'", ".'\""]]
    odd = ["it's", "IT'S", "o'dell'", "a'", "İstanbul", "ΣΑΣ", "e\u0301te\u0301", "E\u0338", "naïve\u0301,", "A<|endoftext|>", "x|>", "ªµº", "ẞ", "×÷", "a\u00adb"]
    texts = [" ".join(forms), *(f"{x}b {x} ab{x}, {x}{x}" for x in letters), " ".join(odd), " ".join(f"a{m}b {m}a" for m in marks)]
    tokens = packing.WordTokens(packing.vocabulary_path())
    got = [
        ids[a:b].tolist() for ids, edges in tokens.in_portions(pa.array(texts, pa.string()))
        for a, b in itertools.pairwise(edges.tolist())
    ]
    assert got == [plain_ids(t) for t in texts]
    tokens.forget()
    list(tokens.in_portions(pa.array([" ".join(forms)])))
    assert len(tokens.known) < 10 + len(marks)  # the word, its marks and nothing


def test_forgotten_words_are_tokenised_again(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 4)
    monkeypatch.setattr(packing, "PORTION", 8)
    texts = ["Aa, bb! 1c", "aa bb cc dd ee", "", "bb! aA, x1"]
    tokens = packing.WordTokens(packing.vocabulary_path())
    got = [
        ids[a:b].tolist() for _ in range(2) for ids, edges in tokens.in_portions(pa.array(texts, pa.string()))
        for a, b in itertools.pairwise(edges.tolist())
    ]
    assert got == 2 * [plain_ids(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8), st.integers(0, 30))
def test_fullest_is_the_best_subset(lengths, room):
    left = [lengths.count(n) for n in range(max(31, room + 1))]
    got = packing.fullest(left, room)
    best = max(sum(c) for k in range(len(lengths) + 1) for c in combinations(lengths, k) if sum(c) <= room)
    assert sum(got) == best
    assert all(got.count(n) <= left[n] for n in got)


def test_plan_uses_every_piece_once():
    rng = random.Random(1)
    counts = [0] + [rng.choice([0, 0, 1, 3, 200]) for _ in range(64)]
    ranks, bins = defaultdict(list), defaultdict(int)
    for n, low, high, first, many, offset in packing.plan(counts, 64):
        for r in range(low, high):
            ranks[n].append(r)
            bins[first + (r - low) // many] += n
    assert all(sorted(ranks[n]) == list(range(c)) for n, c in enumerate(counts))
    assert max(bins.values()) <= 64 and sorted(bins) == list(range(len(bins)))
    total = sum(n * c for n, c in enumerate(counts))
    assert len(bins) <= total / 64 * 1.1 + 2


def check(pieces, rows, capacity):
    expected = sorted((i, p, p * capacity, len(ids[p * capacity : (p + 1) * capacity]), zlib.crc32(np.array(ids[p * capacity : (p + 1) * capacity], "<u4").tobytes()))
                      for i, text in rows for ids in [plain_ids(text)] for p in range(-(-len(ids) // capacity)))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == expected
    places = defaultdict(list)
    for r in pieces:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        assert end <= capacity


def test_round_trip(docs):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["alpha", "beta,", "gamma's", "delta12"], k=rng.choice([0, 3, 3, 3, 40, 500])))) for i in range(200)]
    check(packing.pack(docs(rows).repartition(5), 64).collect(), rows, 64)


def test_odd_rows(docs, odd, clashing):
    named = [(r[0] if r[0] is not None else -1, *r[1:]) for r in odd]
    check(packing.pack(clashing(docs(named))).collect(), [r[:2] for r in named], packing.CAPACITY)
    assert packing.pack(docs(odd)).where("doc_id IS NULL").count() == 1
    assert packing.pack(docs([])).count() == 0
