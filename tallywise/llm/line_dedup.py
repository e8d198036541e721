"""Line dedup by sharded minimal perfect hashes.

1. Every whole text is split at newlines; a line's key is the line without white space at
   both ends, A-Z lower-cased. Keys of at least ``MIN_CHARS`` code points become 128-bit
   hashes, once per row of documents.
2. Distinct line hashes are counted with the smallest and largest id that hold them
   (combined in the tasks before the shuffle). Those held by one document only need no
   place; the others are dealt to shards by their hash, so shards are small and even.
3. Each shard builds a minimal perfect hash: keys alone at their place of a level's bit
   array stay there, the rest go on to the next level, until none is left. A key's slot
   is the number of bits set before its own. Slots index compact arrays: 64 bits of
   fingerprint, the number of rows that hold the line, the document that keeps it.
4. Documents probe the arrays instead of joining lines: probes travel to the shard of
   their hash and stream past its arrays, so a task holds one shard's arrays and a
   batch of probes. A shard whose lines have over a ``SPREAD``-th of all probes is
   copied, and its probes are dealt to the copies by the row they come from; at most
   ``SPREAD`` shards are that full, so the list of them has a fixed bound.
5. Only lines to drop come back to the documents, as a list per row, which is never
   longer than the row's own text.

A line that is in no array is taken for one that is with a probability of 2^-64.

Null and empty texts are one empty line, which is too short to be dropped. Rows that
share an id are one document: a line that only they hold stays in all of them. Rows of
a null id are returned whole and keep no line from others. Very long texts and lines are
handled whole, one at a time. Extra columns are ignored, whatever their names; repeated
rows are returned as often as given. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick
from .textscan import mix

MIN_CHARS = 10
#: Line hashes of a shard, about, and shards at least.
SHARD_KEYS, SHARDS = 4096, 512
#: A shard that is asked for more than this part of all probes is copied.
SPREAD = 4096
#: Places per key in a level's bit array.
ROOM = 2

_HASH = "h1 long, h2 long"


def line_keys(text: bytes) -> list[bytes]:
    """The key of every line; ``strip`` and ``lower`` of bytes touch ASCII only."""
    return [line.strip().lower() for line in text.split(b"\n")]


def long_enough(key: bytes, least: int = MIN_CHARS) -> bool:
    if len(key) < least or len(key) >= 4 * least:  # a code point has at most four bytes
        return len(key) >= least
    return key.isascii() or len(key.decode("utf-8", "replace")) >= least


def digests(keys: list[bytes]) -> np.ndarray:
    """128-bit hashes as rows of two signed 64-bit numbers."""
    packed = b"".join(map(xxhash.xxh3_128_digest, keys))
    return np.frombuffer(packed, "<i8").reshape(-1, 2)


class PerfectHash:
    """Minimal perfect hash over distinct 128-bit keys, given as two arrays of 64 bits."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @staticmethod
    def _places(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = mix(np.array([2 * level + 1, 2 * level + 2], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x = mix((h1 ^ seed[0]) + h2 * (seed[1] | np.uint64(1)))
        return (((x >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes: list[int] = []
        words: list[np.ndarray] = [np.empty(0, np.uint64)]
        while len(h1):
            size = -(-ROOM * len(h1) // 64) * 64
            at = cls._places(h1, h2, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8").astype(np.uint64))
            sizes.append(size)
            again = ~alone[at]
            h1, h2 = h1[again], h2[again]
        return cls(np.array(sizes, np.int64), np.concatenate(words))

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slot of each key; keys that were not given at the start get any slot or -1."""
        out = np.full(len(h1), -1, np.int64)
        left, start = np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = start + self._places(h1[left], h2[left], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            held = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[held]] = (self.before[at >> 6] + below)[held]
            left, start = left[~held], start + size
        return out


class LineShard:
    """Fingerprint, count and keeper of each line hash of a shard, in its slot."""

    def __init__(self, index: PerfectHash, fingerprints: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.index, self.fingerprints, self.counts, self.keepers = index, fingerprints, counts, keepers

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> LineShard:
        index = PerfectHash.build(h1, h2)
        order = np.empty(len(h1), np.int64)
        order[index.slots(h1, h2)] = np.arange(len(h1))
        return cls(index, h2[order], counts[order], keepers[order])

    def parts(self) -> list[bytes]:
        return [x.tobytes() for x in (
            self.index.sizes, self.index.words, self.fingerprints, self.counts, self.keepers)]

    @classmethod
    def load(cls, sizes: bytes, words: bytes, fingerprints: bytes, counts: bytes, keepers: bytes) -> LineShard:
        number, bits = np.dtype(np.int64), np.dtype(np.uint64)
        return cls(
            PerfectHash(np.frombuffer(sizes, number), np.frombuffer(words, bits)),
            *(np.frombuffer(x, t) for x, t in ((fingerprints, bits), (counts, number), (keepers, number))),
        )

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slot of each key that is held here, else -1."""
        slot = self.index.slots(h1, h2)
        slot[(slot >= 0) & (self.fingerprints[np.maximum(slot, 0)] != h2)] = -1
        return slot


_PARTS = ("sizes", "words", "fingerprints", "counts", "keepers")


def _bits(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, one after the last) of each run of equal rows."""
    if len(columns[0]):
        new = np.zeros(len(columns[0]), bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), len(new)]
        yield from zip(edges[:-1], edges[1:], strict=True)


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, text_hash, h1, h2``: the distinct long enough lines of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            counts, found = np.zeros(len(texts), np.int64), [np.empty((0, 2), np.int64)]
            for i in range(len(texts)):
                keys = {k for k in line_keys(texts[i].as_py() or b"") if long_enough(k, min_chars)}
                counts[i] = len(keys)
                found.append(digests(list(keys)))
            row = pa.array(np.repeat(np.arange(len(texts)), counts))
            both = np.concatenate(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(2).take(row), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())],
                names=["doc_id", "text_hash", "h1", "h2"],
            )

    return docs.where("doc_id IS NOT NULL").mapInArrow(run, f"doc_id long, text_hash long, {_HASH}")


def build_shards(repeated: DataFrame, shards: int) -> DataFrame:
    """One row of arrays per shard over ``h1, h2, n, keeper``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrays(shard: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(rows).combine_chunks()
            h1, h2 = (_bits(table.column(c)) for c in ("h1", "h2"))
            built = LineShard.build(h1, h2, *(table.column(c).to_numpy() for c in ("n", "keeper")))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), *(pa.array([x], pa.binary()) for x in built.parts())],
                names=["shard", *_PARTS],
            )

        now, rows = None, []  # rows of one shard, which may go on in the next batch
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            for a, b in _runs(shard):
                if shard[a] != now and rows:
                    yield arrays(now, rows)
                    rows = []
                now = int(shard[a])
                rows.append(batch.slice(a, b - a))
        if rows:
            yield arrays(now, rows)

    dealt = repeated.withColumn("shard", F.expr(f"CAST(pmod(h1, {shards}) AS INT)"))
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        run, "shard int, " + ", ".join(f"{p} binary" for p in _PARTS)
    )


def find_drops(lines: DataFrame, arrays: DataFrame, copies: DataFrame, shards: int) -> DataFrame:
    """``doc_id, text_hash, h1, h2, n``: the lines that a smaller id keeps, ``n`` rows hold.

    ``copies`` (``shard, copies``): the shards whose arrays are copied, at most ``SPREAD``.
    """
    copies = F.broadcast(copies)
    asked = lines.withColumn("shard", F.expr(f"CAST(pmod(h1, {shards}) AS INT)")).join(copies, "shard", "left").select(
        "shard", F.expr("CAST(pmod(xxhash64(doc_id, text_hash), coalesce(copies, 1)) AS INT)").alias("copy"), F.lit(1).alias("kind"),
        "doc_id", "text_hash", "h1", "h2", *(F.lit(None).cast("binary").alias(p) for p in _PARTS),
    )
    held = arrays.join(copies, "shard", "left").select(
        "shard", F.explode(F.expr("sequence(0, CAST(coalesce(copies, 1) AS INT) - 1)")).alias("copy"), F.lit(0).alias("kind"),
        *(F.lit(None).cast("long").alias(c) for c in ("doc_id", "text_hash", "h1", "h2")), *_PARTS,
    )
    names = ["doc_id", "text_hash", "h1", "h2", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, now = None, None
        for batch in batches:
            shard, copy, kind = (batch.column(c).to_numpy() for c in ("shard", "copy", "kind"))
            for a, b in _runs(shard, copy, kind):
                at = (int(shard[a]), int(copy[a]))
                if kind[a] == 0:
                    here, now = at, LineShard.load(*(batch.column(p)[a].as_py() for p in _PARTS))
                elif here == at:
                    own = batch.slice(a, b - a)
                    slot = now.probe(_bits(own.column("h1")), _bits(own.column("h2")))
                    doc = own.column("doc_id").to_numpy()
                    drop = np.flatnonzero((slot >= 0) & (now.keepers[np.maximum(slot, 0)] != doc))
                    if len(drop):
                        yield pa.RecordBatch.from_arrays(
                            [*(own.column(c).take(pa.array(drop)) for c in names[:4]), pa.array(now.counts[slot[drop]])],
                            names=names,
                        )

    together = asked.unionAll(held).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    return together.mapInArrow(run, f"doc_id long, text_hash long, {_HASH}, n long")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per row: ``doc_id, text, n_lines, n_dropped, copies``.

    ``text`` has the lines that stay (a null text is empty), ``copies`` is the largest number of rows that hold one of the dropped lines, or 0.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    docs = pick(docs, {"doc_id": "long", "text": "string"}).withColumn("text_hash", F.xxhash64("text"))
    lines = scratch.save(hashed_lines(docs, min_chars), "lines")
    repeated = scratch.save(
        lines.groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"))
        .where("keeper < last").select("h1", "h2", "n", "keeper"), "repeated",
    )
    shards = max(SHARDS, -(-repeated.count() // SHARD_KEYS))
    most = max(1, lines.count() // SPREAD)
    full = repeated.groupBy(F.expr(f"CAST(pmod(h1, {shards}) AS INT)").alias("shard")).agg(F.sum("n").alias("n"))
    copies = full.where(f"n > {most}").select("shard", F.expr(f"CAST(ceil(n / {most}) AS LONG)").alias("copies"))
    drops = scratch.save(
        find_drops(lines, scratch.save(build_shards(repeated, shards), "arrays"), scratch.save(copies, "copies"), shards)
        .groupBy("doc_id", "text_hash")
        # At most the distinct lines of the texts with this id and hash, which are one text.
        .agg(F.collect_set(F.struct("h1", "h2")).alias("lines"), F.max("n").alias("copies")), "drops",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, listed = batch.column(1).cast(pa.binary()), batch.column(2)
            kept, n_lines, n_dropped = [], [], []
            for i in range(len(texts)):
                text = texts[i].as_py() or b""
                total, gone = text.count(b"\n") + 1, 0
                if listed[i].is_valid:
                    drop = listed[i].values
                    drop = np.column_stack([drop.field(0).to_numpy(), drop.field(1).to_numpy()]).astype("<i8")
                    drop = {x.tobytes() for x in drop}
                    split = text.split(b"\n")
                    stay = [
                        line for line, key in zip(split, line_keys(text), strict=True)
                        if xxhash.xxh3_128_digest(key) not in drop or not long_enough(key, min_chars)
                    ]
                    text, gone = b"\n".join(stay), total - len(stay)
                kept.append(text)
                n_lines.append(total)
                n_dropped.append(gone)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()).view(pa.string()),
                 pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), batch.column(3)],
                names=["doc_id", "text", "n_lines", "n_dropped", "copies"],
            )

    answered = docs.join(drops, ["doc_id", "text_hash"], "left").select(
        "doc_id", "text", "lines", F.coalesce("copies", F.lit(0)).alias("copies"))
    return answered.mapInArrow(run, "doc_id long, text string, n_lines long, n_dropped long, copies long")
