"""Quality rules, language model, toxicity and main text against plain Python on small inputs."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallywise.llm import language_model, main_text, quality_rules, toxicity

SPACE = " \t\n\x0b\x0c\r"


def plain_words(text):
    return [w.decode() for w in (text or "").encode().split()]


def plain_counts(text):
    text = text or ""
    w = plain_words(text)
    windows = list(zip(w, w[1:], w[2:], strict=False))
    often = Counter(windows)
    covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_counts(docs, odd, clashing):
    rng = random.Random(2)
    rows = [*odd[:8], *((20 + i, "\n".join(" ".join(rng.choices("ab#cé|", k=rng.randrange(6))) for _ in range(8))) for i in range(60))]
    got = quality_rules.counts(clashing(docs(rows))).collect()
    for r in got:
        expected = plain_counts(dict(x[:2] for x in rows)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])


@pytest.mark.parametrize(("n", "k", "rate"), [(10, 0, 0.2), (500, 7, 0.02), (5000, 80, 0.02), (40, 30, 0.1)])
def test_binomial_tail(spark, n, k, rate):
    got = spark.sql(f"SELECT {quality_rules.binomial_tail(f'{n}L', f'{k}L', rate)} AS p").first().p
    exact = sum(math.comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1)) if k < n * rate else 1.0
    assert got == pytest.approx(exact, rel=1e-9)


def test_cutoffs_spare_good_documents(docs, labels):
    words = [f"w{i}" for i in range(400)]
    rng = random.Random(4)
    rows = [(i, " ".join(rng.sample(words, 60)) + (" #" * 30 if i % 5 == 0 else ""), "en", "s") for i in range(2500)]
    marks = labels([(i, 0 if i % 5 == 0 else 1, 0) for i in range(2500)])
    judged = {r.doc_id: r for r in quality_rules.judge(docs(rows), marks, max_false_rejection=0.06).collect()}
    assert sum(not judged[i].kept for i in range(0, 2500, 5)) == 500
    assert sum(not judged[i].kept for i in range(2500) if i % 5) <= 0.06 * 2000
    kept = quality_rules.keep_good(docs(rows), marks, max_false_rejection=0.06)
    assert kept.columns == docs(rows).columns and kept.count() == sum(r.kept for r in judged.values())
    # Without labels nothing is certified, so only the base rule rejects.
    assert quality_rules.judge(docs(rows[:20]), labels([])).where("NOT kept AND NOT base_failed").count() == 0
    assert quality_rules.judge(docs([]), marks).count() == 0


def test_language_model(docs, odd, clashing):
    rng = random.Random(6)
    rows = [*odd[:4], *((100 + i, " ".join((["the", "Cat", "sat", "on", "mat"] * 9)[rng.randrange(5) : rng.randrange(5, 40)])) for i in range(150))]
    got = {r.doc_id: r for r in language_model.score(clashing(docs(rows)).repartition(3)).collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 7
    token = lambda t: [w.lower() for w in plain_words(t)] + ["\n"]
    c = Counter(w for i, t in rows if fold(i) != 2 for w in token(t))
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        r = got[i]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in token(t))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i) == 2, len(token(t)), sum(c[w] > 0 for w in token(t)), n)
        assert r.base_score == pytest.approx(base) and r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert language_model.score(docs([])).count() == 0


def plain_model(rows, bins):
    """Scores by dictionaries: counts, expectation-maximisation and interpolation, one token at a time."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 7
    token = lambda t: [w.lower() for w in plain_words(t)] + [None]
    bigrams = lambda t: list(zip([None, *token(t)], token(t), strict=False))
    bucket = lambda c: c.bit_length()

    def counted(folds):
        texts = [t for i, t in rows if fold(i) in folds]
        return Counter(w for t in texts for w in token(t)), Counter(g for t in texts for g in bigrams(t))

    def coarse(ratio):
        return 2 ** ((math.floor(bins * math.log2(ratio)) + 0.5) / bins) if ratio and bins else ratio

    one, two = counted({0, 1, 3, 4, 6})
    n, v, seen = sum(one.values()), len(one), {}
    for v_, w in (g for i, t in rows if fold(i) == 5 for g in bigrams(t)):
        pair = coarse(two[v_, w] / max(one[v_], 1) * (v + 1))
        seen.setdefault(bucket(one[v_]), []).append((pair, coarse(one[w] / n * (v + 1)), 1.0))
    weights = {}
    for b, tokens in seen.items():
        m, before = (0.4, 0.4, 0.2), -math.inf
        while True:
            p = [sum(x * y for x, y in zip(m, t, strict=True)) for t in tokens]
            now = sum(map(math.log, p)) / len(p)
            if now - before < language_model.GAIN:
                break
            before = now
            m = [max(sum(m[k] * t[k] / q for t, q in zip(tokens, p, strict=True)) / len(p), 1e-6) for k in range(3)]
            m = [x / sum(m) for x in m]
        weights[b] = m
    one, two = counted({0, 1, 3, 4, 5, 6})
    n, v = sum(one.values()), len(one)

    def probability(v_, w):
        m2, m1, m0 = weights.get(bucket(one[v_]), (0.5, 0.4, 0.1))
        lower = m1 * one[w] / n + m0 / (v + 1)
        return m2 * two[v_, w] / one[v_] + lower if one[v_] else lower / (m1 + m0)

    return {i: sum(math.log10(probability(*g)) for g in bigrams(t)) for i, t in rows}


@pytest.mark.parametrize("vocabulary", [30, 3000])
def test_language_model_against_plain_python(docs, vocabulary):
    rng = random.Random(vocabulary)
    rows = [(i, " ".join(f"w{min(int(rng.paretovariate(0.6)), vocabulary)}" for _ in range(rng.randrange(120)))) for i in range(250)]
    got = {r.doc_id: r.score for r in language_model.score(docs(rows).repartition(4)).collect()}
    assert got == pytest.approx(plain_model(rows, language_model.BINS_PER_TWO), rel=1e-6)
    # Ratios in bins of a quarter of a power of two change little.
    unbinned = plain_model(rows, None)
    assert sum(got.values()) == pytest.approx(sum(unbinned.values()), rel=2e-3) and got == pytest.approx(unbinned, rel=0.05)


def test_rare_words_of_a_large_corpus_keep_their_ratio():
    ratio = 2.0 ** -np.arange(1, 50)
    assert len(set(language_model._bin(ratio).tolist())) == 49
    # A word with a ratio of 2^-13 to the uniform estimate is better told by the latter.
    rare = language_model.maximise(np.zeros(1, int), language_model._bin(np.array([2.0**-13])), np.array([100]))
    assert rare[2] > 0.99


@pytest.mark.parametrize(("rows", "size"), [(3, 1 << 20), (4096, 500)])
def test_language_model_in_many_blocks(docs, odd, monkeypatch, rows, size):
    texts = [*odd, *((100 + i, "few words here " * (i % 40)) for i in range(60))]
    whole = {r.doc_id: r for r in language_model.score(docs(texts).coalesce(2)).collect()}
    monkeypatch.setattr(language_model, "BLOCK_ROWS", rows)
    monkeypatch.setattr(language_model, "BLOCK_BYTES", size)
    batch = pa.RecordBatch.from_pylist([{"row": i, "doc_id": d, "text": t, "fold": 0} for i, (d, t, *_) in enumerate(texts)])
    blocks = next(language_model._number(rows, size)(iter([batch])))
    for name in set(blocks.column("block").to_pylist()):
        mine = [t for b, t in zip(blocks.column("block").to_pylist(), blocks.column("text").to_pylist(), strict=True) if b == name]
        assert len(mine) == 1 or len(mine) <= rows and sum(len((t or "").encode()) for t in mine) <= size
    for r in language_model.score(docs(texts).coalesce(2)).collect():
        assert r[:5] == whole[r.doc_id][:5] and r[5:] == pytest.approx(whole[r.doc_id][5:])


def test_language_model_whatever_the_splits(spark, docs, tmp_path, monkeypatch):
    """Every job may split the texts elsewhere, as when executors come or go between the jobs."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(300)], k=60))) for i in range(400)]
    path = str(tmp_path / "docs")
    docs(rows).coalesce(1).write.option("parquet.block.size", 4096).parquet(path)
    whole = sorted(language_model.score(spark.read.parquet(path)).collect())
    set_size = lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    save, seen, sizes = language_model.Scratch.save, [], iter((7000, 3000, 5000))

    def other_splits(self, df, name="t", **options):
        out = save(self, df, name, **{**options, "parquet.block.size": "4096", "parquet.page.size.row.check.min": "10",
                                      "parquet.block.size.row.check.min": "10"})
        set_size(next(sizes))
        seen.append(out.select("piece").distinct().count() if name == "answers" else 0)
        return out

    monkeypatch.setattr(language_model.Scratch, "save", other_splits)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        df = language_model.score(spark.read.parquet(path))
        set_size(2000)
        got = sorted(df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert max(seen) > 1  # the block was read in pieces
    assert [r[:5] for r in got] == [r[:5] for r in whole]
    assert [r[5:] for r in got] == [pytest.approx(r[5:]) for r in whole]


def test_toxicity_catches_misspellings(docs, labels, odd, clashing):
    rng = random.Random(8)
    plain = [f"{a}{b}" for a in ("tre", "mol", "san", "vik") for b in ("da", "ren", "tos", "lia")]
    texts = [(i, " ".join(rng.choices(plain, k=60))) for i in range(400)]
    texts = [(i, t.replace(t.split()[3], "blockhead", 1) if i % 4 == 0 else t) for i, t in texts]
    marks = labels([(i, 1, int(i % 4 == 0)) for i, _ in texts[:300]])
    extra = [(1000, "sanda blockheads tosmol"), (1001, "molda vikren sanda treda")]
    rows = docs([*texts, *extra, *((2000 + k, t[1]) for k, t in enumerate(odd))])
    score = {r.doc_id: r.score for r in toxicity.score(clashing(rows), marks).collect()}
    held = range(300, 400)
    assert all((score[i] >= 0.7) == (i % 4 == 0) for i in held)
    assert score[1000] >= 0.7 > score[1001] and all(0 <= s <= 1 for s in score.values())
    assert score[2001] < 0.7
    assert toxicity.score(docs([]), marks).count() == 0
    assert {r.score for r in toxicity.score(docs(odd), labels([])).collect()} == {0.0}


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x="</p>";</script></head><body>
<header class="top">Site</header><nav><ul><li><a href=/a>A</a></ul></nav><div class="cookie-notice">We use cookies, sorry.</div>
<main><article><h1>Head &amp; line</h1><p>First   part, with <b>bold<br>and <i>more</i>.<p>Second &eacute; part, longer text, with commas.
<div class="ad">Buy, buy, buy</div><blockquote>Quoted words</blockquote><pre>a
 b</pre></article><aside>Other</aside></main><section id=comments><p>Nice, really nice, text, I say.</p></section><footer>&copy; X</footer>"""


@pytest.mark.parametrize(("page", "text"), [
    (PAGE, "Head & line\nFirst part, with bold and more.\nSecond é part, longer text, with commas.\nQuoted words\na b"),
    (None, ""), ("", ""), ("<p>Only one, paragraph", "Only one, paragraph"), ("<!-- never closed <p>x</p>", ""),
    ("<article><p>One<p>Two &amp three</article><p cla", "One\nTwo & three"),
])
def test_main_text(page, text):
    assert main_text.main_text(page) == text


LONG = [f"Paragraph {i}, " + "with words, and more of them, " * 10 + "end." for i in range(30)]
BODY = "".join(f"<p>{x}</p>" for x in LONG)


@pytest.mark.parametrize("wrapper", [
    '<div class="site has-sidebar">', '<div class="no-sidebar">', "<div class='content-with-rail'>", '<div id="search-page">',
    '<div class="modal-open"><div class="with-banner">', "<form action=/x>",
])
def test_frame_of_the_page_stays(wrapper):
    around = '<div class="sidebar"><p>Side, text, here.</p></div><div class="comments"><article class="comment"><p>Nice, I say.</p></article></div>'
    end = "</form>" if "form" in wrapper else "</div>" * wrapper.count("<div")
    for count in (1, 30):
        body, text = "".join(f"<p>{x}</p>" for x in LONG[:count]), LONG[:count]
        page = f"<body>{wrapper}<article><h1>Head</h1>{body}</article>{around}{end}<footer>F</footer></body>"
        assert main_text.main_text(page).split("\n") == ["Head", *text]
    page = f"<body>{wrapper}<div>{BODY}</div>{around}{end}</body>"
    assert main_text.main_text(page).split("\n") == LONG


def test_long_comments_stay_out():
    comments = f'<div id="comments"><h3>Comments</h3>{BODY}</div>'
    for page in (f"<article><p>Short, text.</p></article>{comments}", f"<div class=content><p>{LONG[0]}</p>" + f"<p>{LONG[1]}</p>" * 9 + f"</div>{comments}"):
        assert main_text.main_text(page).split("\n") in (["Short, text."], [LONG[0]] + [LONG[1]] * 9)


def test_whole_article_is_kept():
    rest = "<ul><li>One item</li></ul><blockquote>Short quote</blockquote><pre>code</pre><figure><figcaption>Seen</figcaption></figure>"
    after = ["One item", "Short quote", "code", "Seen"]
    for name in ("article", "main"):
        page = f'<body><{name}><h1>Head</h1><div class=body>{BODY}</div>{rest}<div class="share">Share it</div></{name}></body>'
        assert main_text.main_text(page).split("\n") == ["Head", *LONG, *after]
    page = f"<article><section><h2>A</h2><p>Only, one.</p></section><section><h2>B</h2>{BODY}</section></article>"
    assert main_text.main_text(page).split("\n") == ["A", "Only, one.", "B", *LONG]
    page = f"<body><div><h1>Head</h1><div class=body>{BODY}</div>{rest}</div></body>"
    assert main_text.main_text(page).split("\n") == ["Head", *LONG, *after]
    page = f"<body><section><p>Only, one.</p></section><section>{BODY}</section><div class=comments>{BODY[:300]}</div></body>"
    assert main_text.main_text(page).split("\n") == ["Only, one.", *LONG]


def test_extract(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "<div>" * 3000 + "deep " * 9000, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = main_text.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 4
    assert all(r.n_chars == len(r.text) for r in got.collect())
    assert main_text.extract(df.limit(0)).count() == 0
