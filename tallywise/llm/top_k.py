"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is sparse: its terms are the components that are not zero after
quantisation, ``floor(scale * x)``. Candidates are packed into blocks in place, each
an inverted index: per term the postings (row, weight). Queries are packed into
blocks of rows too. Candidate blocks are dealt to ``parts`` and query blocks to
``tiles``; for each pair of a part and a tile one task reads the tile's query blocks
and then candidate block after candidate block. Against each it accumulates a query
block's scores, term by term, in a dense array: terms whose postings hold much of the
rows all at once, as a product of the weights with the postings in dense form, the
others by scattering each query row's weight over the postings. What scores at least a
query row's k-th best so far is merged into its k best by (score, smaller id), and
partial results of the same query are merged by a second selection.

The queries are a stated set that meets every candidate, in blocks, which is the work
asked for. No join is left to a size estimate, so nothing is broadcast, however Spark
is set; the driver gets two sums. Blocks, tiles and parts are bounded in bytes, their
number grows with the data. Exact for any vectors: scores are integers, ties go to the
smaller id, candidates without a common term score 0 and take part. Scores are
accumulated in floats only as wide as a bound of the sums needs to stay exact, else as
64-bit integers.

Vectors that are null or hold null or non-finite components take no part; an empty
vector scores 0. Vectors of different lengths are compared over the common terms.
A row never meets candidates of its own id; repeated rows of one id and vector are one
query (rows of one id and several vectors share a list), while each of them is a
candidate. Null ids take no part. Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, pick

SCALE = 256
#: Vectors of a candidate block and queries of a query block; components that close a block before.
BLOCK, QUERIES, VALUES = 2048, 512, 1 << 20
#: Bytes of the query blocks and of the candidate blocks that meet in a task.
TILE, PART = 32 << 20, 32 << 20
#: A term is kept in dense form if its postings hold this share of a block's rows; so many terms at most.
SHARE, COMMON = 1 / 8, 4096
LOWEST = np.iinfo(np.int64).min


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, terms``: quantised components of the vectors that take part."""
    df = pick(vectors, {"vec_id": "long", "embedding": "array<double>"})
    return df.where("""
        vec_id IS NOT NULL AND embedding IS NOT NULL
        AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))
    """).select("vec_id", F.expr(f"transform(embedding, x -> CAST(floor({scale} * x) AS LONG))").alias("terms"))


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    return x.astype(next(t for t in ("i1", "i2", "i4", "i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _blocks(size: int, values: int = VALUES):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of ids and of the terms in rows: lengths and values as bytes; ``no`` deals them in turn."""
        ids, terms, lengths = [], [], []
        no = TaskContext.get().partitionId()

        def block() -> pa.RecordBatch:
            i, t, n = (np.concatenate(x) for x in (ids, terms, lengths))
            for x in (ids, terms, lengths):
                x.clear()
            t = _narrow(t)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([no], pa.int64()), pa.array([t.itemsize], pa.int32()),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (i, t, n)),
                ],
                names=["no", "width", "ids", "terms", "lengths"],
            )

        for batch in batches:
            longest = int(batch.column(1).value_lengths().to_numpy(zero_copy_only=False).max(initial=1))
            step = max(1, min(size, values // max(longest, 1)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids.append(part.column(0).to_numpy(zero_copy_only=False))
                terms.append(part.column(1).flatten().to_numpy(zero_copy_only=False))
                lengths.append(part.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int32))
                if sum(map(len, ids)) >= size or sum(map(len, terms)) >= values:
                    yield block()
                    no += 1
        if ids:
            yield block()

    return pack


class Postings:
    """Terms of the rows of a block that are not zero; ``longest`` is the largest length of a vector."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray, lengths: np.ndarray):
        self.ids = ids
        row = np.repeat(np.arange(len(ids)), lengths)
        term = np.arange(len(row)) - np.repeat(np.cumsum(lengths, dtype=np.int64) - lengths, lengths)
        some = terms != 0
        self.row, self.term, self.weight = row[some], term[some], terms[some]
        squares = np.bincount(self.row, self.weight.astype(np.float64) ** 2, 1)
        self.longest = float(np.sqrt(squares.max())) * (1 + 1e-9)


class Candidates(Postings):
    """An inverted index, rows in order of their ids: common terms in dense form, the others as lists."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray, lengths: np.ndarray):
        super().__init__(ids, terms, lengths)
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        self.ids, row = ids[order], rank[self.row]
        count = np.bincount(self.term)
        common = np.flatnonzero(count >= max(1, SHARE * len(ids)))
        if len(common) > COMMON:
            common = common[np.argsort(-count[common], kind="stable")[:COMMON]]
        self.place = np.full(len(count) + 1, -1)  # the last is for the terms of queries that no row has
        self.place[common] = np.arange(len(common))
        at = self.place[self.term]
        there = at >= 0
        dense = np.zeros((len(common), len(ids)), np.int64)
        dense[at[there], row[there]] = self.weight[there]
        self.dense = {np.int64: dense}
        row, term, weight = row[~there], self.term[~there], self.weight[~there].astype(np.int64)
        by_term = np.lexsort((row, term))
        self.rest_row, self.rest_weight = row[by_term], weight[by_term]
        self.rest_at = np.searchsorted(term[by_term], np.arange(len(count) + 2))

    def scores(self, queries: Postings) -> np.ndarray:
        """Of each query row with each row of the block; no partial sum passes the product of the lengths."""
        bound = self.longest * queries.longest
        kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
        if kind not in self.dense:
            self.dense[kind] = self.dense[np.int64].astype(kind)
        term = np.minimum(queries.term, len(self.place) - 1)
        at = self.place[term]
        there = at >= 0
        weights = np.zeros((len(queries.ids), len(self.dense[kind])), kind)
        weights[queries.row[there], at[there]] = queries.weight[there]
        out = weights @ self.dense[kind]
        for n in np.flatnonzero(self.rest_at[term + 1] > self.rest_at[term]):
            a, b = self.rest_at[term[n]], self.rest_at[term[n] + 1]
            out[queries.row[n], self.rest_row[a:b]] += (int(queries.weight[n]) * self.rest_weight[a:b]).astype(kind)
        return out


class Best:
    """The k best candidates so far of each row of a query block."""

    def __init__(self, queries: Postings, k: int):
        self.queries, self.k = queries, k
        self.score = np.full((len(queries.ids), k), LOWEST)
        self.id = np.zeros((len(queries.ids), k), np.int64)
        self.found = np.zeros(len(queries.ids), np.int64)

    def meet(self, block: Candidates) -> None:
        scores, k, n = block.scores(self.queries), self.k, len(block.ids)
        own, end = (np.searchsorted(block.ids, self.queries.ids, side) for side in ("left", "right"))
        for q in np.flatnonzero(own < end):
            scores[q, own[q] : end[q]] = LOWEST
        least = self.score[:, -1].astype(scores.dtype)
        new = np.flatnonzero(self.found < k)
        if len(new) and n > k:
            least[new] = np.maximum(least[new], np.partition(scores[new], n - k, axis=1)[:, n - k])
        some = np.flatnonzero(scores.max(axis=1) >= least)
        if not len(some):
            return
        at, row = np.divmod(np.flatnonzero(scores[some] >= least[some, None]), n)
        query = some[at]
        other = block.ids[row] != self.queries.ids[query]
        query, row = query[other], row[other]
        value = scores[query, row].astype(np.int64)
        start = np.searchsorted(query, np.arange(len(self.found) + 1))
        keep = np.ones(len(query), bool)
        small = block.longest * self.queries.longest * n < 2**62
        for q in np.flatnonzero(np.diff(start) > 4 * k):
            a, b = start[q], start[q + 1]
            if small:  # one number that orders by score, then by smaller id
                best = np.argpartition(value[a:b] * n - row[a:b], b - a - k)[b - a - k :]
            else:
                best = np.lexsort((row[a:b], ~value[a:b]))[:k]
            keep[a:b] = False
            keep[a + best] = True
        had = np.arange(k) < self.found[some, None]
        query = np.concatenate([np.repeat(some, self.found[some]), query[keep]])
        value = np.concatenate([self.score[some][had], value[keep]])
        ids = np.concatenate([self.id[some][had], block.ids[row[keep]]])
        order = np.lexsort((ids, ~value, query))
        query, value, ids = query[order], value[order], ids[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        query, value, ids, rank = (x[rank < k] for x in (query, value, ids, rank))
        self.score[query, rank], self.id[query, rank] = value, ids
        self.found[some] = np.bincount(query, minlength=len(self.found))[some]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, candidate ids and scores."""
        had = np.arange(self.k) < self.found[:, None]
        return np.repeat(self.queries.ids, self.found), self.id[had], self.score[had]


def _gathered(blocks: list[tuple[np.ndarray, ...]], k: int) -> list[Best]:
    """Small query blocks put together."""
    out, held, rows, values = [], [], 0, 0
    for block in [*blocks, None]:
        if held and (block is None or rows + len(block[0]) > QUERIES or values + len(block[1]) > VALUES):
            out.append(Best(Postings(*(np.concatenate(x) for x in zip(*held, strict=True))), k))
            held, rows, values = [], 0, 0
        if block is not None:
            held.append(block)
            rows, values = rows + len(block[0]), values + len(block[1])
    return out


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks arrive by key, queries before candidates."""
        key, blocks, best = None, [], None

        def results() -> Iterator[pa.RecordBatch]:
            for one in best or []:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in one.rows()], names=["query_id", "vec_id", "score"]
                )

        for batch in batches:
            for n in range(batch.num_rows):
                this, candidates, width = (batch.column(c)[n].as_py() for c in range(3))
                if this != key:
                    yield from results()
                    key, blocks, best = this, [], None
                got = tuple(
                    np.frombuffer(batch.column(c)[n].as_buffer(), t)
                    for c, t in ((3, "i8"), (4, f"i{width}"), (5, "i4"))
                )
                if not candidates:
                    blocks.append(got)
                    continue
                if best is None:
                    best, blocks = _gathered(blocks, k), []
                block = Candidates(*got) if best else None
                for one in best:
                    one.meet(block)
        yield from results()

    return run


def search(vectors: DataFrame, is_query: str, k: int = 5, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best candidates per query row."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    block = "no long, width int, ids binary, terms binary, lengths binary"
    ready = usable(vectors, scale)
    candidates = scratch.save(ready.mapInArrow(_blocks(BLOCK), block), "candidates")
    queries = scratch.save(
        ready.where(is_query).dropDuplicates(["vec_id", "terms"]).mapInArrow(_blocks(QUERIES), block), "queries"
    )

    def sums(blocks: DataFrame) -> tuple[int, int]:
        length = F.expr("octet_length(ids) + octet_length(terms) + octet_length(lengths)")
        n, size = blocks.agg(F.count("*"), F.coalesce(F.sum(length), F.lit(0))).first()
        return n, size

    (blocks, size), (_, q_size) = sums(candidates), sums(queries)
    tiles = max(1, -(-q_size // TILE))
    parts = max(1, min(blocks, max(4 * spark.sparkContext.defaultParallelism, -(-size // PART))))
    to = ["key", "candidates", "width", "ids", "terms", "lengths"]
    # A block goes to one tile of all parts or to one part of all tiles; each pair of them is a task.
    left = queries.withColumn("tile", F.expr(f"CAST(no % {tiles} AS INT)")).withColumn(
        "key", F.explode(F.expr(f"transform(sequence(0, {parts - 1}), p -> tile * {parts} + p)"))
    ).withColumn("candidates", F.lit(False))
    right = candidates.withColumn("part", F.expr(f"CAST(no % {parts} AS INT)")).withColumn(
        "key", F.explode(F.expr(f"transform(sequence(0, {tiles - 1}), t -> t * {parts} + part)"))
    ).withColumn("candidates", F.lit(True))
    met = (
        left.select(to).union(right.select(to))
        .repartitionById(parts * tiles, F.col("key")).sortWithinPartitions("key", "candidates")
    )
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    # Spark keeps k rows per query and task before the shuffle.
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
