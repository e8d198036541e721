"""Best-fit packing of token sequences by minimum bin slack.

Texts are tokenised once; longer documents are cut into pieces of the capacity. What
bins are made of depends on how many pieces there are of each length only, at most
``capacity`` numbers whatever the input. Per bin the largest length left is taken
first, then a subset-sum dynamic program over bitsets of the other lengths left finds
the fullest feasible combination. The combination is removed as many times as
there are pieces for it, since the next bins would repeat it; each combination uses up
one length at least, so there are at most ``capacity`` of them.

Pieces get a rank within their length, counted per task and summed up over tasks,
and the plan maps intervals of ranks to bins and places. So no task holds all
pieces of a length, even if one length has a third of all.

Tokenisation remembers the tokens of words, in a worker over all its tasks: the vocabulary's
rules never look beyond white space, so a word has the same tokens everywhere. Nor do they
look from a run of letters to the marks behind it or tell capitals apart, so most words are
remembered as a run in lower case and its marks: far fewer distinct ones.

Null and empty texts have the end token only. Repeated rows are packed one by one.
Empty input gives an empty result.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, pick

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
END_ID = 0
#: Words remembered by a worker.
REMEMBERED = 600_000
#: Bytes of text that are looked up at once.
PORTION = 4 << 20

#: Joins words for the tokeniser, and words joined to one line.
JOINT, LINE = "1", 1000
#: A run of Latin letters, all of them composed and with one lower-case letter each, and ASCII's marks behind it.
PARTS = r"^(?P<run>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-/:-@\[-`{-~]*)$"

_NUMBER = np.dtype("<u4")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def parts(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The run of letters and the marks of each word, or nothing and the whole word if it has other characters."""
    found = pc.extract_regex(words, PARTS)
    run, marks = (pc.struct_field(found, k).cast(words.type) for k in range(2))
    return pc.fill_null(pc.utf8_lower(run), ""), pc.coalesce(marks, words)


def gathered(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The ids of the wanted words one after the other."""
    n = lengths[wanted]
    stop = np.cumsum(n)
    return ids[np.arange(n.sum()) + np.repeat(starts[wanted] - (stop - n), n)]


class WordTokens:
    """Ids of whole texts; words are looked up by number in one array of ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        (self.joint,) = self.tokenizer.encode(JOINT, add_special_tokens=False).ids
        # For runs in lower case, which the vocabulary's own rules would leave as they are.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary, suffix = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        """Word 0 is nothing."""
        self.known: dict[str, int] = {"": 0}
        self.ids = np.empty(0, _NUMBER)
        self.starts, self.lengths = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def numbers(self, words: list[str], tokenise: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Numbers of distinct words, of which new ones are tokenised."""
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            ids, lengths = tokenise(new)
            known.update(zip(new, range(len(self.lengths), len(self.lengths) + len(new)), strict=True))
            self.starts = np.append(self.starts, len(self.ids) + np.cumsum(lengths) - lengths)
            self.lengths = np.append(self.lengths, lengths)
            self.ids = np.append(self.ids, ids)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def runs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``tokenised``, for runs of letters in lower case; the vocabulary marks their last ids."""
        lines = [" ".join(words[i : i + LINE]) for i in range(0, len(words), LINE)]
        encoded = [e.ids for e in self.plain.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.fromiter(itertools.chain.from_iterable(encoded), _NUMBER)
        at = np.flatnonzero(self.last[ids])
        assert len(at) == len(words)
        return ids, np.diff(at, prepend=-1)

    def tokenised(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and how many each has.

        Digits are tokens of their own in this vocabulary, so words without the digit 1 are
        handed over in lines that it joins, and its id parts their ids again.
        """
        joint = [w for w in words if JOINT not in w]
        lines = [joint[i : i + LINE] for i in range(0, len(joint), LINE)]
        single = [w for w in words if JOINT in w]
        encode = lambda texts: [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = lambda parts: np.fromiter(itertools.chain.from_iterable(parts), _NUMBER)
        encoded = flat([*i, self.joint] for i in encode([JOINT.join(x) for x in lines]))
        at = np.flatnonzero(encoded == self.joint)
        assert len(at) == len(joint)
        own = encode(single)
        ids = np.concatenate([np.delete(encoded, at), flat(own)])
        parts = np.concatenate([np.diff(at, prepend=-1) - 1, np.fromiter(map(len, own), np.int64, len(own))])
        # Back in the order of the words.
        apart = np.fromiter((JOINT in w for w in words), bool, len(words))
        order = np.argsort(np.argsort(apart, kind="stable"), kind="stable")
        lengths, first = parts[order], (np.cumsum(parts) - parts)[order]
        stop = np.cumsum(lengths)
        return ids[np.arange(len(ids)) + np.repeat(first - (stop - lengths), lengths)], lengths

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after the other, and how many each has."""
        run, rest = (part.dictionary_encode() for part in parts(words))
        if len(self.known) + len(run.dictionary) + len(rest.dictionary) > REMEMBERED:
            self.forget()
        in_turn = np.column_stack([
            self.numbers(part.dictionary.to_pylist(), tokenise)[part.indices.to_numpy()]
            for part, tokenise in ((run, self.runs), (rest, self.tokenised))
        ])
        return gathered(self.ids, self.starts, self.lengths, in_turn.ravel()), self.lengths[in_turn].sum(axis=1)

    def in_portions(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of some texts one after the other, each with its end; where each text starts and the last ends)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PORTION, "right")))
            words = pc.ascii_split_whitespace(texts.slice(at, end - at))
            per_text = words.value_lengths().to_numpy()
            coded = words.flatten().dictionary_encode()
            ids, lengths = self.of_words(coded.dictionary)
            # Word 0 is the end of a text, and stands behind the words of every one.
            ids, lengths = np.append(_NUMBER.type(END_ID), ids), np.append(1, lengths)
            ends = np.cumsum(per_text + 1) - 1
            all_words = np.zeros(len(coded) + len(ends), np.int64)
            inside = np.ones(len(all_words), bool)
            inside[ends] = False
            all_words[inside] = coded.indices.to_numpy() + 1
            stop = np.cumsum(lengths[all_words])
            yield gathered(ids, np.cumsum(lengths) - lengths, lengths, all_words), np.concatenate([[0], stop[ends]])
            at = end


@lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """One for all tasks that a worker runs."""
    return WordTokens(path)


def cut(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, task, nth``; nth counts pieces of a length within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path or vocabulary_path())
        task = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            doc, ids = 0, batch.column(0).to_pylist()
            rows: list[tuple] = []
            for found, edges in tokens.in_portions(batch.column(1)):
                view = memoryview(found).cast("B")
                for a, b in itertools.pairwise(edges.tolist()):
                    for piece, start in enumerate(range(a, b, capacity)):
                        n = min(capacity, b - start)
                        crc = zlib.crc32(view[start * _NUMBER.itemsize : (start + n) * _NUMBER.itemsize])
                        rows.append((ids[doc], piece, start - a, n, crc, task, seen[n]))
                        seen[n] += 1
                    doc += 1
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                        pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
                )

    return pick(docs, {"doc_id": "long", "text": "string"}).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
    )


def fullest(left: list[int], room: int) -> list[int]:
    """The combination of lengths with the largest sum of at most ``room``; ``left`` counts pieces by length."""
    steps: list[tuple[int, int, int]] = []  # length, copies, sums that could be reached before
    sums, mask, goal = 1, (1 << (room + 1)) - 1, 1 << room
    for length in range(room, 0, -1):
        copies, many = min(left[length], room // length), 1
        while copies and not sums & goal:
            many = min(many, copies)
            steps.append((length, many, sums))
            sums |= (sums << (length * many)) & mask
            copies -= many
            many *= 2
        if sums & goal:
            break
    total, chosen = sums.bit_length() - 1, []
    for length, many, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * many
            total -= length * many
    return chosen


def plan(counts: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, low, high, bin, many, offset): pieces of ranks low to high go to bins from ``bin`` on.

    ``many`` of them, side by side from ``offset`` on, go to each bin.
    """
    left, taken, bins = list(counts), [0] * (capacity + 1), 0
    rows: list[tuple[int, int, int, int, int, int]] = []
    for largest in range(capacity, 0, -1):
        while left[largest]:
            left[largest] -= 1
            combination = [largest, *fullest(left, capacity - largest)]
            left[largest] += 1
            sizes = {n: combination.count(n) for n in combination}
            times = min(left[n] // m for n, m in sizes.items())
            offset = 0
            for n, m in sizes.items():
                rows.append((n, taken[n], taken[n] + m * times, bins, m, offset))
                taken[n] += m * times
                left[n] -= m * times
                offset += n * m
            bins += times
    return rows


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    pieces = scratch.save(cut(docs, capacity, path), "pieces")
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch.save(per_task.select(
        "length", "task", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "starts")
    counts = [0] * (capacity + 1)
    for row in starts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[row.length] = row.n
    by_length: dict[int, list[tuple]] = {}
    for n, low, _, first_bin, many, offset in plan(counts, capacity):
        by_length.setdefault(n, []).append((low, first_bin, many, offset))
    steps = {n: np.array(rows, np.int64).T for n, rows in by_length.items()}
    held = spark.sparkContext.broadcast(steps)  # at most ``capacity`` combinations

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            values, first = np.unique(length[order], return_index=True)
            for n, own in zip(values.tolist(), np.split(order, first[1:]), strict=True):
                low, first_bin, many, begin = held.value[n]
                step = np.searchsorted(low, rank[own], "right") - 1
                nth = rank[own] - low[step]
                sequence[own] = first_bin[step] + nth // many[step]
                offset[own] = begin[step] + nth % many[step] * n
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = pieces.join(starts.select("length", "task", "before"), ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
