"""Global order without a task that holds it all: ranks, running totals, list ranks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Rows that one window sums up.
BLOCK = 4096
#: Links that one task follows.
LIMIT = 1 << 16


def ranked(scratch: Scratch, df: DataFrame, order: Sequence[str], rank: str) -> DataFrame:
    """``df`` with ``rank`` from 0 on in ascending order (nulls first), as a saved table.

    Rows are dealt out by ranges of the whole order, so no value of its first columns
    has to fit one task; rows equal in all of ``order`` do share one.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    saved = scratch.save(dealt.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    parts = saved.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"))
    # One row per partition of the shuffle.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return (
        saved.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(starts), "_part")
        .withColumn(rank, F.expr(f"_start + (_at & {(1 << 33) - 1})")).drop("_part", "_at", "_start")
    )


def running(scratch: Scratch, df: DataFrame, place: str, columns: Sequence[str], size: int, how: str = "sum") -> DataFrame:
    """``df`` with ``running_<column>``: totals (``sum`` or ``bit_xor``) up to and including each row.

    ``place`` numbers the rows from 0 to ``size`` - 1. Blocks of places are summed on
    their own; the totals of the blocks before come from the same function.
    """
    fold = getattr(F, how)
    together = "+" if how == "sum" else "^"
    apart = "-" if how == "sum" else "^"
    block = f"{place}_block"
    blocks = df.withColumn(block, F.expr(f"{place} div {BLOCK}"))
    upto = Window.partitionBy(block).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    within = blocks.withColumns({f"running_{c}": fold(c).over(upto) for c in columns})
    if size <= BLOCK:
        return within.drop(block)
    totals = scratch.save(blocks.groupBy(block).agg(*(fold(c).alias(c) for c in columns)), "blocks")
    before = running(scratch, totals, block, columns, -(-size // BLOCK), how)
    before = before.select(block, *(F.expr(f"running_{c} {apart} {c}").alias(f"_before_{c}") for c in columns))
    return within.join(before, block).withColumns(
        {f"running_{c}": F.expr(f"running_{c} {together} _before_{c}") for c in columns}
    ).drop(block, *(f"_before_{c}" for c in columns))


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps to the end of at most ``LIMIT`` links, by pointer jumping."""
    parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in range(3)] for b in batches]
    if not parts:
        return
    arc, to, far = (np.concatenate([p[c] for p in parts]) for c in range(3))
    arc, far = arc.astype(np.int64), far.astype(np.int64)
    order = np.argsort(arc)
    arc, to, far = arc[order], to[order], far[order]
    ends = np.isnan(to.astype(float))
    at = np.append(np.where(ends, len(arc), np.searchsorted(arc, np.where(ends, 0, to).astype(np.int64))), len(arc))
    far = np.append(far, 0)
    while (at[:-1] != len(arc)).any():
        far, at = far + far[at], at[at]
    yield pa.RecordBatch.from_arrays([pa.array(arc), pa.array(far[:-1])], names=["arc", "far"])


def list_ranks(scratch: Scratch, links: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, int]:
    """(``arc, place``, number of arcs): places from 0 on along the list ``arc, next``.

    ``next`` is null at the end. Each round takes out the arcs whose hash is smaller
    than that of both neighbours, about a third, none beside another, and links their
    neighbours. What one task can follow is ranked there; then the rounds are
    undone, each arc standing as many steps before its successor as it was linked over. The
    tables of all rounds together are some three times the first.
    """
    back = links.where("next IS NOT NULL").select(F.col("next").alias("arc"), F.col("arc").alias("prev"))
    state = scratch.save(links.join(back, "arc", "left").select("arc", "prev", "next", F.lit(1).cast("long").alias("steps")), "links")
    total = left = state.count()
    taken: list[DataFrame] = []
    while left > limit:
        h = lambda c: F.xxhash64(F.lit(len(taken)), c)  # noqa: E731, B023
        least = F.coalesce((h("arc") < h("prev")) & (h("arc") < h("next")), F.lit(False))
        gone = scratch.save(state.where(F.col("prev").isNotNull() & F.col("next").isNotNull() & least), "taken")
        none = F.lit(None).cast("long")
        told = state.where(F.col("prev").isNull() | F.col("next").isNull() | ~least).select(
            "arc", "prev", "next", "steps", none.alias("new_prev"), none.alias("new_next")
        ).unionAll(
            gone.select("prev", none, none, "steps", none, "next")
        ).unionAll(
            gone.select("next", none, none, F.lit(0).cast("long"), "prev", none)
        )
        after = scratch.save(told.groupBy("arc").agg(
            F.coalesce(F.max("new_prev"), F.max("prev")).alias("prev"),
            F.coalesce(F.max("new_next"), F.max("next")).alias("next"), F.sum("steps").alias("steps"),
        ), "links")
        scratch.drop(state)
        state, left = after, after.count()
        taken.append(gone)
    far = scratch.save(state.select("arc", "next", "steps").coalesce(1).mapInArrow(_follow, "arc long, far long"), "far")
    for gone in reversed(taken):
        beyond = far.select(F.col("arc").alias("next"), "far")
        added = gone.join(beyond, "next").select("arc", (F.col("steps") + F.col("far")).alias("far"))
        far = scratch.save(far.unionAll(added), "far")
    return far.select("arc", (F.lit(total) - F.col("far")).alias("place")), total
