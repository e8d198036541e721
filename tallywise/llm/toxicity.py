"""Toxicity from subword-bag embeddings averaged into a linear softmax.

A word is the mean of the embeddings of its character n-grams (3 to 5 bytes, with
word boundaries) and of itself, all hashed to ``BUCKETS`` rows, so a misspelling that
was never seen shares most of its vectors with the word it comes from. Words are
averaged over passages of about ``WIDTHS`` words, short ones for single insults and longer
ones for what only shows in several words, and a linear softmax gives a passage's logits. A
document's logit is a soft maximum over its passages, which keeps one insult in a long
text from being averaged away. Embeddings and softmax are trained jointly in numpy by
full-batch gradient descent with momentum on a bounded, documented sample: of the
labelled documents that are there, ``SAMPLE`` clean and toxic ones by the hash of their
id, without texts of over ``LONGEST`` bytes and up to ``SAMPLE_BYTES`` of text a class.
Labels are the only thing learned from.

A bucket is learned if ``LEAST_DOCS`` documents hold it, whatever their share, and if the
classes hold it at rates that differ by ``APART`` standard errors; others keep the weight 0.
So insults of a small language count like those of a large one.

As everything up to the logit is linear, scoring needs one number per bucket; these
numbers (a fixed 512 KB) travel to the tasks, which score whole texts of any length with
array operations over bytes.

Null and empty texts have no words and get the score of the bias alone, which is
below any cutoff unless most labels are toxic. Without labels of both classes every
score is 0. A document that occurs twice is scored twice; of several texts of one id
one is learned from. Null ids are scored and never learned from. Extra columns stay; an
older column ``score`` is replaced in ``score`` and kept in ``keep_clean``. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pick
from .textscan import ALNUM, LOWER, factors, mix, places, slices, word_hashes, words

BUCKETS = 1 << 17
DIM = 4
GRAMS = (3, 4, 5)
#: Words of a passage, about.
WIDTHS = (2, 8)
#: Most labelled documents learned from: clean, toxic; bytes of one text and of each class.
SAMPLE = (1600, 800)
LONGEST, SAMPLE_BYTES = 16 << 10, 3 << 20
STEPS = 120
RATE = 0.5
DECAY = 1e-5
#: A bucket is learned if it occurs in as many documents and tells the classes apart so well.
LEAST_DOCS, APART = 3, 2.0
#: Bytes of text whose words are taken up at once in training.
PORTION = 1 << 18
CUTOFF = 0.7

_SHIFT = np.uint64(64 - 17)
_GRAM_FACTORS = {n: factors(n, 10 + n) for n in GRAMS}


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word number, bucket) of every subword, one pair of arrays per gram length and one for whole words.

    Words are padded with a boundary byte on both sides.
    """
    length = ends - starts
    padded = length + 2
    total = int(padded.sum())
    first = np.cumsum(padded) - padded
    word = np.repeat(np.arange(len(starts)), padded)
    place = np.arange(total) - first[word]
    at = starts[word] + place - 1
    edge = (place == 0) | (place == padded[word] - 1)
    value = np.where(edge, 1, LOWER[data[np.clip(at, 0, max(len(data) - 1, 0))]]).astype(np.uint64)
    for n, f in _GRAM_FACTORS.items():
        if total < n:
            continue
        h = np.full(total - n + 1, n, np.uint64)
        for k in range(n):
            h += value[k : total - n + 1 + k] * f[k]
        ok = place[: total - n + 1] <= padded[word[: total - n + 1]] - n
        yield word[: total - n + 1][ok], (mix(h[ok]) >> _SHIFT).astype(np.int64)
    whole = np.add.reduceat(value * places(int(padded.max()))[place], first)
    yield np.arange(len(starts)), (mix(whole) >> _SHIFT).astype(np.int64)


def passages(per_row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of nearly equal passages of at most ``width`` words, and each passage's row.

    ``per_row``: the number of each row's first word, one more at the end.
    """
    n = np.diff(per_row)
    pieces = -(-n // width)
    row = np.repeat(np.arange(len(n)), pieces)
    k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return per_row[row] + k * n[row] // np.maximum(pieces[row], 1), row


def passage_means(values: np.ndarray, firsts: list[np.ndarray]) -> np.ndarray:
    """Mean of the words' values over the passages of all widths, one width after the other."""
    return np.concatenate([np.add.reduceat(values, f) / np.diff(np.append(f, len(values))) for f in firsts])


def softmax_pool(logits: np.ndarray, row: np.ndarray, rows: int, sharp: float) -> tuple[np.ndarray, np.ndarray]:
    """Soft maximum of the passages' logits per row, and each passage's weight in it."""
    top = np.full(rows, -np.inf)
    np.maximum.at(top, row, logits)
    top = np.where(np.isfinite(top), top, 0)
    e = np.exp(sharp * (logits - top[row]))
    total = np.bincount(row, e, rows)
    weight = e / total[row]
    return np.where(total > 0, np.bincount(row, weight * logits, rows), 0.0), weight


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of each word's distinct form in order of the texts, words per text, and the
    (form, bucket) pairs of the forms' subwords."""
    hashes, counts, forms, buckets = [], [], [], []
    seen = np.empty(0, np.uint64)
    for _, _, data, offsets in slices(texts, PORTION):
        starts, ends, per_row = words(data, offsets, ALNUM)
        h = word_hashes(LOWER[data], starts, ends)
        own, at = np.unique(h, return_index=True)
        new = ~np.isin(own, seen, assume_unique=True)
        if new.any():
            own, at = own[new], at[new]
            seen = np.union1d(seen, own)
            for word, bucket in subwords(data, starts[at], ends[at]):
                forms.append(own[word])
                buckets.append(bucket.astype(np.int32))
        hashes.append(h)
        counts.append(np.diff(per_row))
    none = np.empty(0, np.uint64)
    number = lambda parts: np.searchsorted(seen, np.concatenate([none, *parts])).astype(np.int32)
    return (
        number(hashes), np.concatenate([np.empty(0, np.int64), *counts]), number(forms),
        np.concatenate([np.empty(0, np.int32), *buckets]),
    )


def telling(form: np.ndarray, bucket: np.ndarray, word: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which buckets are learned: by the documents of each class that hold their forms."""
    doc = np.repeat(np.arange(len(n)), n)
    held = np.unique(word.astype(np.int64) * len(n) + doc)
    held_form, held_doc = held // len(n), held % len(n)
    forms = int(word.max()) + 1
    rates, total = [], [toxic.sum(), (1 - toxic).sum()]
    for own in (toxic, 1 - toxic):
        per_form = np.bincount(held_form, own[held_doc], forms)
        rates.append(np.bincount(bucket, per_form[form], BUCKETS))
    both = np.clip(sum(rates) / sum(total), 1e-12, 0.5)
    error = np.sqrt(both * (1 - both) * (1 / total[0] + 1 / total[1]))
    return (sum(rates) >= LEAST_DOCS) & (np.abs(rates[0] / total[0] - rates[1] / total[1]) >= APART * error)


def train(texts: pa.Array | list[str], toxic: np.ndarray, steps: int = STEPS, seed: int = 7) -> np.ndarray | None:
    """Logit share per bucket (last entry: the bias), or None without both classes.

    Memory is some 25 times the texts' bytes.
    """
    toxic = np.asarray(toxic, float)
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    if isinstance(texts, list):
        texts = pa.array(texts, pa.large_string())
    word, n, form, bucket = distinct_words(texts)
    if not len(word):
        return None
    forms = int(word.max()) + 1
    share = 1.0 / np.bincount(form, minlength=forms)
    learned = telling(form, bucket, word, n, toxic)[bucket]
    form, (used, bucket) = form[learned], np.unique(bucket[learned], return_inverse=True)
    bucket = bucket.astype(np.int32)
    firsts, rows = zip(*(passages(np.concatenate([[0], np.cumsum(n)]), w) for w in WIDTHS), strict=True)
    sizes = [np.diff(np.append(f, len(word))) for f in firsts]
    row = np.concatenate(rows)

    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (len(used), DIM))
    out = rng.normal(0, 0.5, (DIM, 2))
    bias = np.zeros(2)
    state = [[np.zeros_like(p), np.zeros(())] for p in (emb, out, bias)]
    for step in range(steps):
        sharp = 0.5 + 3.5 * step / max(1, steps - 1)
        # Of the two logits only the difference counts, so one number per bucket goes through the averages.
        apart = out[:, 1] - out[:, 0]
        value = np.bincount(form, (emb @ apart)[bucket], forms) * share
        logit = passage_means(value[word], list(firsts)) + bias[1] - bias[0]
        pooled, weight = softmax_pool(logit, row, len(n), sharp)
        error = (1 / (1 + np.exp(-np.clip(pooled, -50, 50))) - toxic) / len(n)
        d_logit = error[row] * weight
        d_word, at = np.zeros(len(word)), 0
        for size in sizes:
            d_word += np.repeat(d_logit[at : at + len(size)] / size, size)
            at += len(size)
        d_form = np.bincount(word, d_word, forms) * share
        d_bucket = np.bincount(bucket, d_form[form], len(used))
        d_apart = emb.T @ d_bucket
        total = d_logit.sum()
        grads = (
            np.outer(d_bucket, apart) + DECAY * emb,
            np.stack([-d_apart, d_apart], 1) + DECAY * out, np.array([-total, total]),
        )
        for p, g, (m, v) in zip((emb, out, bias), grads, state, strict=True):
            m += 0.1 * (g - m)
            # One scale per array: rare buckets must not move as far as telling ones.
            v += 0.1 * (np.abs(g).max(initial=0) ** 2 - v)
            p -= RATE * m / (np.sqrt(v) + 1e-12)
    model = np.zeros(BUCKETS + 1, np.float32)
    model[used] = emb @ (out[:, 1] - out[:, 0])
    model[-1] = bias[1] - bias[0]
    return model


def sample(docs: DataFrame, labels: DataFrame, size: tuple[int, int] = SAMPLE) -> DataFrame:
    """``doc_id, toxic, text`` of the labelled documents learned from, at most ``sum(size)``."""
    marked = pick(labels, {"doc_id": "long", "toxic": "int"}).where("toxic IN (0, 1) AND doc_id IS NOT NULL")
    docs = pick(docs, {"doc_id": "long", "text": "string"})
    present = docs.select("doc_id").join(marked, "doc_id").distinct().select("toxic", "doc_id", F.xxhash64("doc_id").alias("h"))
    chosen = [present.where(f"toxic = {c}").orderBy("h", "doc_id").limit(size[c]) for c in (0, 1)]
    # At most sum(size) ids: a bounded side, whatever the input.
    wanted = F.broadcast(chosen[0].unionAll(chosen[1]))
    texts = (
        docs.where(f"octet_length(text) <= {LONGEST}").join(wanted, "doc_id")
        .groupBy("doc_id", "toxic", "h").agg(F.min("text").alias("text"))
    )
    # Windows over at most size[c] short texts.
    upto = Window.partitionBy("toxic").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return texts.withColumn("bytes", F.sum(F.octet_length("text")).over(upto)).where(
        f"bytes <= {SAMPLE_BYTES}").select("doc_id", "toxic", "text")


def learn(docs: DataFrame, labels: DataFrame, size: tuple[int, int] = SAMPLE) -> np.ndarray | None:
    """Train on a sample of the labelled documents; all labelled rows given may be used."""
    got = sample(docs, labels, size).toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")]).combine_chunks()
    return train(got.column("text").combine_chunks(), got.column("toxic").to_numpy().astype(float))


def score_texts(column: pa.Array, model: np.ndarray | None) -> np.ndarray:
    out = np.zeros(len(column))
    if model is None:
        return out
    for i, j, data, offsets in slices(column):
        starts, ends, per_row = words(data, offsets, ALNUM)
        pooled = np.zeros(j - i)
        if len(starts):
            total, n = np.zeros(len(starts)), np.zeros(len(starts))
            for word, bucket in subwords(data, starts, ends):
                total += np.bincount(word, model[bucket], len(starts))
                n += np.bincount(word, minlength=len(starts))
            firsts, rows = zip(*(passages(per_row, w) for w in WIDTHS), strict=True)
            pooled = softmax_pool(passage_means(total / n, list(firsts)), np.concatenate(rows), j - i, 4.0)[0]
        out[i:j] = 1 / (1 + np.exp(-np.clip(pooled + float(model[-1]), -500, 500)))
    return out


def score(docs: DataFrame, labels: DataFrame, training_docs: DataFrame | None = None) -> DataFrame:
    """All columns of ``docs`` and ``score``; an older column of that name is replaced.

    ``labels`` (``doc_id, toxic``) are the only rows learned from.
    """
    docs = docs.drop("score")
    model = learn(training_docs if training_docs is not None else docs, labels)
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most 512 KB
    names = docs.columns
    at = names.index("text")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    schema = ", ".join([*fields, "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            result = pa.array(score_texts(batch.column(at), held.value))
            yield pa.RecordBatch.from_arrays([*batch.columns, result], names=[*names, "score"])

    return docs.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``docs`` without those that score ``cutoff`` or more, all columns unchanged."""
    names = docs.columns
    own = next(f"own_score{i}" for i in range(len(names) + 1) if f"own_score{i}" not in names)
    scored = score(docs.withColumnRenamed("score", own), labels).where(F.col("score") < cutoff).drop("score")
    return scored.withColumnRenamed(own, "score").select(*(f"`{c}`" for c in names))
