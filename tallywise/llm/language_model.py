"""Bigram language model smoothed by deleted interpolation.

    p(w | v) = m2(b) * c(v, w) / c(v) + m1(b) * c(w) / N + m0(b) / (V + 1)

c are counts in the training documents, N and V those of all tokens and of distinct ones, b
the bucket of the context's frequency c(v) (powers of two). The weights m are learned by expectation-maximisation on held-out
counts: one fold of the training documents is deleted, the n-grams of that fold are
the held-out data, and the maximum-likelihood estimates come from the other folds.
Scoring then uses the counts of all training documents with these weights.

Counts cover all training documents and grow with them. They are made by numpy on
packed arrays, moved and partitioned by Spark: a block (at most ``BLOCK_ROWS`` rows and
about ``BLOCK_BYTES``, or one longer text) sends its distinct n-gram hashes with their counts
to ``parts`` shares of the hash range; each share adds them up and answers every block with
the totals in the order asked. So every distinct n-gram of a block crosses the network once
each way, a frequent one is no more than one entry per block, and no task holds more than a
share or a block. Shares without an n-gram of a block get no row, so
there are never more rows than distinct n-grams of blocks, which grow with the input.

The texts are written once, with a number per row and block. How later jobs split that table
may change from job to job with the cores at hand, so a block can be read in several pieces:
each piece asks for itself under the number of its first row, and the answers are met again
by these saved numbers. Answers that are not for the very hashes of a piece stop the job. Expectation-
maximisation needs a histogram only: the weights depend on the ratio of the two
estimates to the uniform one, which are kept per bucket in bins of a quarter of a power of two.
The bins reach as far as 64-bit counts do, so no ratio is clipped. Its rounds end when they no
longer gain.

Tokens are white-space words with A-Z in lower case, then one end per text, which is
also the context of the first token. Words are represented by 64-bit hashes.

Null and empty texts have the end token. Repeated rows count every time. Null ids go to
the fold of the empty string. Without training documents all counts are 0: the
model is then uniform with probability 1. Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick
from .textscan import LOWER, mix, slices, word_hashes, words

FOLDS, HELD_OUT, DELETED = 7, 2, 5
BUCKETS = 64
#: Ratios of the estimates are kept from 2^-64 to 2^64 in bins of a quarter, bin 0 is for no count.
BINS_PER_TWO, LEAST, MOST = 4, -64, 64
BINS = (MOST - LEAST) * BINS_PER_TWO + 1
#: Expectation-maximisation ends when a round gains less, in nats a token.
GAIN = 1e-9
#: Rows and bytes of a block; a longer text is a block of its own.
BLOCK_ROWS, BLOCK_BYTES = 4096, 16 << 20

_END = np.uint64(0x5851F42D4C957F2D)
_CONTEXT = np.uint64(0xD6E8FEB86659FD93)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all rows, and each row's first (one more at the end)."""
    parts, first, total = [], [np.zeros(1, np.int64)], 0
    for i, j, data, offsets in slices(column):
        data = LOWER[data]
        starts, ends, per_row = words(data, offsets)
        n = j - i
        at = per_row + np.arange(n + 1)
        out = np.full(int(at[-1]), _END, np.uint64)
        keep = np.ones(len(out), bool)
        keep[at[1:] - 1] = False
        out[keep] = word_hashes(data, starts, ends)
        parts.append(out)
        first.append(total + at[1:])
        total += int(at[-1])
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.concatenate(first)


def grams(token: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context of every token and hash of the pair."""
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[first[:-1]] = _END
    return context, mix(context * _CONTEXT + token)


def _key(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class Block:
    """Distinct words and pairs of a block, sorted by hash, which also sorts them by share."""

    def __init__(self, columns: list[pa.Array]):
        token, first = zip(*(tokens(c) for c in columns), strict=True)
        shift = np.cumsum([0, *(len(t) for t in token)])
        self.token = np.concatenate(token)
        self.first = np.concatenate([np.zeros(1, np.int64), *(f[1:] + s for f, s in zip(first, shift, strict=False))])
        self.context, pair = grams(self.token, self.first)
        self.word, self.word_at = np.unique(self.token, return_inverse=True)
        self.pair, self.pair_at = np.unique(pair, return_inverse=True)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[pa.Array], np.ndarray]]:
    """(block, first row, texts, folds) of rows of one block that follow each other, from ``row, block, doc_id, text, fold``."""
    block = piece = last = None
    columns, folds = [], []
    for batch in batches:
        row, name = (batch.column(i).to_numpy() for i in (0, 1))
        edges = np.flatnonzero((np.diff(row) != 1) | (np.diff(name) != 0)) + 1
        for at, end in zip([0, *edges.tolist()], [*edges.tolist(), len(row)], strict=True):
            if at == end:
                continue
            if name[at] != block or row[at] != last + 1:
                if columns:
                    yield block, piece, columns, np.concatenate(folds)
                block, piece, columns, folds = int(name[at]), int(row[at]), [], []
            last = int(row[end - 1])
            columns.append(batch.column(3).slice(at, end - at))
            folds.append(batch.column(4).slice(at, end - at).to_numpy(zero_copy_only=False))
    if columns:
        yield block, piece, columns, np.concatenate(folds)


def _small(counts: np.ndarray) -> bytes:
    """A byte per count; counts from 255 on follow in full, 8 bytes each."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def _large(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", offset=n)
    return counts


ASK = "block long, piece long, share int, kind int, hashes binary, counts binary, deleted binary"


def _ask(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(share: int, kind: int, *data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([piece]), pa.array([share], pa.int32()), pa.array([kind], pa.int32()),
                 *(pa.array([x], pa.binary()) for x in data)],
                names=["block", "piece", "share", "kind", "hashes", "counts", "deleted"],
            )

        for name, piece, columns, folds in _pieces(batches):
            block = Block(columns)
            fold = np.repeat(folds, np.diff(block.first))
            for kind, values, at in ((0, block.word, block.word_at), (1, block.pair, block.pair_at)):
                counts = np.bincount(at[fold != HELD_OUT], minlength=len(values))
                deleted = np.bincount(at[fold == DELETED], minlength=len(values))
                edge = np.searchsorted(_key(values, parts), np.arange(parts + 1))
                for share, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                    if a < b:
                        yield row(share, kind, values[a:b].tobytes(), _small(counts[a:b]), _small(deleted[a:b]))
            yield row(piece // BLOCK_ROWS % parts, 2, _deleted_tokens(block, fold == DELETED), b"", b"")

    return run


def _deleted_tokens(block: Block, held: np.ndarray) -> bytes:
    """The distinct (pair, word, context) of deleted documents as places in the answers, with their counts."""
    context = np.empty_like(block.word_at)
    context[1:] = block.word_at[:-1]
    context[block.first[:-1]] = np.searchsorted(block.word, _END)
    _, at, n = np.unique(block.pair_at[held], return_index=True, return_counts=True)
    rows = [x[held][at] for x in (block.pair_at, block.word_at, context)] + [n]
    return np.stack(rows).astype("<i4").tobytes()


ANSWER = "block long, piece long, share int, kind int, size int, digest long, counts binary, deleted binary, words long, tokens long, kept_words long, kept_tokens long"


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """Totals of one share and kind for every piece that asked, in the order asked; kind 2 is handed on."""
    n = len(table)
    same = [table.column(c).combine_chunks() for c in ("block", "piece", "share", "kind")]
    names = [f.split()[0] for f in ANSWER.split(", ")]
    if key[1].as_py() == 2:
        none = pa.array([0] * n, pa.int64())
        return pa.Table.from_arrays(
            [*same, pa.array([0] * n, pa.int32()), none, table.column("hashes").combine_chunks(), pa.array([b""] * n, pa.binary()), *[none] * 4], names=names
        )
    hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")]
    values, at = np.unique(np.concatenate(hashes), return_inverse=True)
    edges = np.cumsum([len(h) for h in hashes])[:-1]

    def summed(name: str) -> np.ndarray:
        own = [_large(x.as_py(), len(h)) for x, h in zip(table.column(name), hashes, strict=True)]
        return np.bincount(at, np.concatenate(own), len(values)).astype(np.int64)

    totals, deleted = summed("counts"), summed("deleted")
    kept = totals - deleted
    facts = [int((totals > 0).sum()), int(totals.sum()), int((kept > 0).sum()), int(kept.sum())]
    own = np.split(at, edges)
    return pa.Table.from_arrays(
        [*same, pa.array([len(o) for o in own], pa.int32()), pa.array([_digest(h) for h in hashes], pa.int64()),
         pa.array([_small(totals[o]) for o in own], pa.binary()), pa.array([_small(deleted[o]) for o in own], pa.binary()),
         # The facts of a share are told once.
         *(pa.array([f] + [0] * (n - 1), pa.int64()) for f in facts)],
        names=names,
    )


def _digest(hashes: np.ndarray) -> int:
    return int(mix(hashes).sum(dtype=np.uint64).astype(np.int64))


def _checked(block: Block, rows: list[dict]) -> dict[tuple[int, str], np.ndarray]:
    """Totals told to a piece, if they are for its own hashes."""
    for kind, values in ((0, block.word), (1, block.pair)):
        at = 0
        for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["share"]):
            if r["digest"] != _digest(values[at : at + r["size"]]):
                raise RuntimeError(f"answers for other n-grams than those of the piece at row {r['piece']}")
            at += r["size"]
        if at != len(values):
            raise RuntimeError(f"{at} answers for {len(values)} n-grams of a piece of block {rows[0]['block'] if rows else None}")
    return _told(rows)


def _told(answers: list[dict]) -> dict[tuple[int, str], np.ndarray]:
    """Totals per kind, put together from the shares."""
    rows = sorted(answers, key=lambda r: (r["kind"], r["share"]))
    return {
        (kind, name): np.concatenate([_large(r[name], r["size"]) for r in rows if r["kind"] == kind])
        for kind in (0, 1) for name in ("counts", "deleted")
    }


def _estimates(block: Block, word: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: its count, its pair's count, its context's count."""
    count = word[block.word_at]
    context = np.empty_like(count)
    context[1:] = count[:-1]
    ends = np.flatnonzero(block.word == _END)
    context[block.first[:-1]] = word[ends[0]] if len(ends) else 0
    return count, pair[block.pair_at], context


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)


def _bin(ratio: np.ndarray) -> np.ndarray:
    """0 for a ratio of 0, else the number of its bin."""
    with np.errstate(divide="ignore"):
        at = np.floor((np.log2(ratio) - LEAST) * BINS_PER_TWO)
    return np.where(ratio > 0, np.clip(at, 0, BINS - 2) + 1, 0).astype(np.int64)


def _held_out_counts(kept_words: int, kept_tokens: int):
    def run(key: tuple, answers: pa.Table) -> pa.Table:
        """Deleted tokens of a piece by context bucket and by the ratios of both estimates to the uniform one."""
        rows = answers.to_pylist()
        told = _told(rows)
        word, pair = (told[k, "counts"] - told[k, "deleted"] for k in (0, 1))
        (index,) = (r["counts"] for r in rows if r["kind"] == 2)
        at = dict(zip(("pair", "word", "context", "n"), np.frombuffer(index, "<i4").reshape(4, -1), strict=True))
        context = word[at["context"]]
        cells = (bucket_of(context) * BINS + _bin(pair[at["pair"]] / np.maximum(context, 1) * (kept_words + 1))) * BINS
        cells += _bin(word[at["word"]] / max(kept_tokens, 1) * (kept_words + 1))
        cells, place = np.unique(cells, return_inverse=True)
        n = np.bincount(place, at["n"], len(cells)).astype(np.int64)
        values = (cells // BINS // BINS, cells // BINS % BINS, cells % BINS)
        return pa.Table.from_arrays(
            [*(pa.array(v.astype(np.int32)) for v in values), pa.array(n)], names=["bucket", "pair_bin", "word_bin", "n"])

    return run


def maximise(pair_bin: np.ndarray, word_bin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of the pair, word and uniform estimate by expectation-maximisation."""
    if not len(n) or not n.sum():
        return np.array([0.5, 0.4, 0.1])
    middle = lambda b: np.where(b > 0, 2.0 ** (LEAST + (b - 0.5) / BINS_PER_TWO), 0.0)
    ratio = np.stack([middle(pair_bin), middle(word_bin), np.ones(len(n))], 1)
    m = np.array([0.4, 0.4, 0.2])
    before = -np.inf
    while True:
        share = m * ratio
        p = share.sum(1, keepdims=True)
        now = float((np.log(p[:, 0]) * n).sum() / n.sum())
        if now - before < GAIN:
            return m
        before = now
        m = ((share / p) * n[:, None]).sum(0) / n.sum()
        m = np.maximum(m, 1e-6)
        m /= m.sum()


def _scores(weights: np.ndarray, n_words: int, n_tokens: int):
    def run(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        told: dict[int, list[dict]] = {}
        for r in answers.to_pylist():
            told.setdefault(r["piece"], []).append(r)
        row, firsts = texts.column("row").to_numpy(), np.array(sorted(told), np.int64)
        piece = np.searchsorted(firsts, row, "right") - 1
        if not len(firsts) or piece.min() < 0:
            raise RuntimeError(f"no answers for block {key[0]}")
        return pa.concat_tables(
            scored(texts.filter(pa.array(piece == i)), told[first]) for i, first in enumerate(firsts.tolist())
        )

    def scored(texts: pa.Table, rows: list[dict]) -> pa.Table:
        block = Block(texts.column("text").chunks)
        told = _checked(block, rows)
        count, both, context = _estimates(block, told[0, "counts"], told[1, "counts"])
        m = weights[bucket_of(context)]
        # Without any count of the context its weight goes to the lower orders.
        p = m[:, 0] * both / np.maximum(context, 1)
        lower = (m[:, 1] * count / max(n_tokens, 1) + m[:, 2] / (n_words + 1)) / (m[:, 1] + m[:, 2])
        p += np.where(context > 0, 1 - m[:, 0], 1.0) * (lower if n_tokens else 1.0)
        base = np.log10((count + 1) / (n_tokens + n_words + 1))
        at = block.first[:-1]
        held = texts.column("fold").to_numpy() == HELD_OUT
        return pa.Table.from_arrays(
            [texts.column("doc_id").combine_chunks(), pa.array(held), pa.array(np.diff(block.first)),
             pa.array(np.add.reduceat((count > 0).astype(np.int64), at)), pa.array(np.full(len(at), n_tokens)),
             pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(np.log10(p), at))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


def _number(most_rows: int, most_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``row, doc_id, text, fold`` with the block, which is named by its first row."""
        block, rows, size = 0, 0, 0
        for batch in batches:
            names = []
            lengths = pc.fill_null(pc.binary_length(batch.column(2)), 0)
            for number, n in zip(batch.column(0).to_pylist(), lengths.to_pylist(), strict=True):
                if not rows or rows == most_rows or size + n > most_bytes:
                    block, rows, size = number, 0, 0
                rows, size = rows + 1, size + n
                names.append(block)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.int64()), *batch.columns[1:]], names=["row", "block", "doc_id", "text", "fold"])

    return run


def _blocks(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """``row, block, doc_id, text, fold``, written once: rows and blocks keep their numbers however they are read."""
    rows = pick(docs, {"doc_id": "long", "text": "string"}).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "text",
        F.expr(f"CAST(pmod(crc32(coalesce(CAST(doc_id AS STRING), '')), {FOLDS}) AS INT)").alias("fold"),
    )
    # A task numbers its own rows, so no block has rows of two files.
    numbered = rows.mapInArrow(_number(BLOCK_ROWS, BLOCK_BYTES), "row long, block long, doc_id long, text string, fold int")
    return scratch.save(numbered, "texts", compression="zstd")


def score(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    scratch = Scratch(docs.sparkSession, "lm")
    texts = _blocks(scratch, docs)
    size = texts.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    parts = 1 + size // BLOCK_BYTES
    answers = scratch.save(
        texts.mapInArrow(_ask(parts), ASK).groupBy("share", "kind").applyInArrow(_answer, ANSWER), "answers"
    )
    facts = answers.where("kind = 0").agg(*(
        F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "tokens", "kept_words", "kept_tokens")
    )).first()
    answers = answers.select("block", "piece", "share", "kind", "size", "digest", "counts", "deleted")
    histogram = (
        answers.groupBy("piece")
        .applyInArrow(_held_out_counts(facts.kept_words, facts.kept_tokens), "bucket int, pair_bin int, word_bin int, n long")
        .groupBy("bucket", "pair_bin", "word_bin").agg(F.sum("n").alias("n"))
    )
    cells = histogram.toArrow()  # at most BUCKETS * BINS * BINS rows, whatever the input; those that occur are far fewer
    bucket, pair_bin, word_bin, n = (cells.column(c).to_numpy() for c in ("bucket", "pair_bin", "word_bin", "n"))
    weights = np.array([
        maximise(pair_bin[bucket == b], word_bin[bucket == b], n[bucket == b]) for b in range(BUCKETS)
    ])
    return (
        texts.groupBy("block").cogroup(answers.where("kind < 2").groupBy("block"))
        .applyInArrow(
            _scores(weights, facts.words, facts.tokens),
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )
