"""Exact order statistics without sorting a whole group in one task.

``F.percentile`` keeps every distinct value of a group in one task's memory and
``row_number`` sorts a whole group in one task. With five segments over billions
of persons neither holds. Both questions here are answered by narrowing instead:

1. count rows per (group, value bucket), a bucket being a monotone function of
   the value, and run the counts up: this names the few buckets that hold the
   wanted ranks;
2. read again, keep only rows of those buckets, and sort their distinct values.

Step 1 shuffles one row per task, group and bucket. Step 2 filters before it
shuffles, against (wanted ranks x groups) rows. A bucket spans 1/4096 of a
doubling (0.017 %): for amounts around 100.00 it holds one or two different cent
values however many rows there are. Rows are read twice, so callers pass stage
tables or projections of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..params import BUCKETS_PER_OCTAVE

# Doubles range over exponents -1074..1023; this keeps bucket numbers positive.
_OFFSET = 1075 * BUCKETS_PER_OCTAVE + 1

# Hex digits of the tie key that ties are bucketed by: 65,536 even buckets.
_TIE_PREFIX = 4


@dataclass(frozen=True)
class Quantile:
    """One wanted output column: the ``prob`` quantile of ``source``."""

    name: str
    source: str
    prob: float = 0.5


def value_bucket(value: Column) -> Column:
    """Bucket number that never decreases as the value grows."""
    step = F.floor(F.log2(F.abs(value)) * F.lit(float(BUCKETS_PER_OCTAVE))) + F.lit(_OFFSET)
    return F.when(value > 0, step).when(value < 0, -step).otherwise(F.lit(0)).cast("long")


def tie_key(identifier: Column) -> Column:
    """Fixed order among equal values: evenly spread digest, then the id itself."""
    text = identifier.cast("string")
    return F.concat(F.md5(text), F.lit(":"), text)


def _running(counts: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Add ``before``: rows of the group ahead of this entry."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return counts.withColumn("before", F.sum("n").over(upto) - F.col("n"))


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: Sequence[Quantile],
    fixed_groups: bool = True,
) -> DataFrame:
    """Exact linear-interpolation quantiles, one row per group.

    All columns share the passes. Groups with a null key are left out. The
    narrowed side has two rows per group and probability. It is broadcast when
    the number of groups is fixed (``fixed_groups``: segments, or no keys);
    else it carries no hint and Spark decides from its size.
    """
    keys = list(keys)
    sources = list(dict.fromkeys(q.source for q in wanted))
    probs = {s: sorted({q.prob for q in wanted if q.source == s}) for s in sources}

    measures = F.array(*[
        F.struct(F.lit(i).alias("m"), F.col(s).cast("double").alias("v"))
        for i, s in enumerate(sources)
    ])
    rows = (
        df.select(*keys, F.inline(measures))
        .filter("v is not null")
        .withColumn("bucket", value_bucket(F.col("v")))
    )
    group = [*keys, "m"]
    buckets = _running(
        rows.groupBy(*group, "bucket").agg(F.count(F.lit(1)).alias("n")), group, "bucket"
    ).withColumn("total", F.sum("n").over(Window.partitionBy(*group)))
    per_measure = ", ".join(
        f"array({', '.join(f'{p!r}D' for p in probs[s])})" for s in sources
    )
    picks = (
        buckets.withColumn("p", F.expr(f"explode(array({per_measure})[m])"))
        .withColumn("position", F.expr("p * (total - 1)"))
        .withColumn(
            "rank", F.expr("explode(array_distinct(array(floor(position), ceil(position))))")
        )
        .filter("rank >= before and rank < before + n")
        .selectExpr(
            *group, "bucket", "p", "rank - before as rank", "position - floor(position) as frac"
        )
    )

    wish = [*group, "bucket", "p", "frac", "rank"]
    held = (
        rows.join(F.broadcast(picks) if fixed_groups else picks, [*group, "bucket"])
        .groupBy(*wish, "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    found = _running(held, wish, "v").filter("rank >= before and rank < before + n")

    def chosen(q: Quantile) -> list[Column]:
        here = (F.col("m") == sources.index(q.source)) & (F.col("p") == q.prob)
        return [
            F.min(F.when(here, F.col("v"))).alias(f"{q.name}__lo"),
            F.max(F.when(here, F.col("v"))).alias(f"{q.name}__hi"),
            F.max(F.when(here, F.col("frac"))).alias(f"{q.name}__frac"),
        ]

    ends = found.groupBy(*keys).agg(*[c for q in wanted for c in chosen(q)])
    return ends.select(
        *keys,
        *[
            interpolate(
                F.col(f"{q.name}__lo"), F.col(f"{q.name}__hi"), F.col(f"{q.name}__frac"), q.prob
            ).alias(q.name)
            for q in wanted
        ],
    )


def interpolate(lo: Column, hi: Column, frac: Column, prob: float) -> Column:
    """Between two neighbours; counted from the nearer one, so equal ends are exact."""
    if prob == 0.5:
        return F.when(frac == 0, lo).otherwise((lo + hi) / 2)
    return F.when(frac < 0.5, lo + (hi - lo) * frac).otherwise(hi - (hi - lo) * (1 - frac))


def rank_cuts(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    identifier: str,
    cuts: DataFrame,
) -> DataFrame:
    """The row at a given rank of each group, in (value, tie key) order.

    ``cuts`` holds (keys..., cut, rank) with ranks from 1 and a fixed number of
    rows. The result (keys..., cut, cut_value, cut_tie) splits a group without
    ranking it: rows up to the rank are those with
    ``(value, tie key) <= (cut_value, cut_tie)``.
    """
    keys = list(keys)
    rows = (
        df.select(*keys, value.alias("v"), F.col(identifier).alias("id"))
        .filter("v is not null")
        .withColumn("bucket", value_bucket(F.col("v")))
    )
    reached = "rank > before and rank <= before + n"
    buckets = _running(
        rows.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n")), keys, "bucket"
    )
    small = F.broadcast(cuts.select(*keys, "cut", "rank"))
    picks = _match(buckets, small, keys).filter(reached).selectExpr(
        *keys, "cut", "bucket", "rank - before as rank"
    )
    held = (
        rows.join(F.broadcast(picks), [*keys, "bucket"])
        .groupBy(*keys, "cut", "rank", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    cut_values = _running(held, [*keys, "cut", "rank"], "v").filter(reached).selectExpr(
        *keys, "cut", "v as cut_value", "rank - before as rank"
    )

    # The rows that equal a cut value may be many: narrow their tie keys the same way.
    ties = (
        rows.select(*keys, F.col("v").alias("cut_value"), "id")
        .join(F.broadcast(cut_values), [*keys, "cut_value"])
        .withColumn("tie", tie_key(F.col("id")))
        .withColumn("prefix", F.substring("tie", 1, _TIE_PREFIX))
    )
    prefixes = _running(
        ties.groupBy(*keys, "cut", "rank", "prefix").agg(F.count(F.lit(1)).alias("n")),
        [*keys, "cut", "rank"], "prefix",
    ).filter(reached).selectExpr(*keys, "cut", "prefix", "rank - before as place")
    in_order = Window.partitionBy(*keys, "cut").orderBy("tie")
    return (
        ties.join(F.broadcast(prefixes), [*keys, "cut", "prefix"])
        .withColumn("position", F.row_number().over(in_order))
        .filter("position = place")
        .select(*keys, "cut", "cut_value", F.col("tie").alias("cut_tie"))
    )


# Without keys the few cuts meet the buckets of the one group there is.
def _match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys)) if keys else left.crossJoin(right)


def up_to_cut(value: Column, identifier: Column, cut_value: Column, cut_tie: Column) -> Column:
    """Is this row at or before the cut? The digest is only taken on a tie."""
    return F.when(value < cut_value, True).when(value > cut_value, False).otherwise(
        tie_key(identifier) <= cut_tie
    )
