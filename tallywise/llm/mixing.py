"""Mixing sources to target weights by temperature.

A source with token share p gets the weight p^a / sum(p^a). The exponent a between 0
(all equal) and 1 (as they are) is bisected to meet a target entropy, given as a share
of the largest possible one; if some source would then be repeated more than
``max_passes`` times, a is bisected upwards until none is. Every step probes ``PROBES``
exponents in one aggregation over the table of sources, which never leaves Spark.

The budget defaults to the least number of tokens that gives every document at least
one pass. Weights are realised as budgeted block permutations: the documents of a
source fall into at most ``BLOCKS`` blocks by hash, each pass goes through all blocks in
an order of its own, and the last pass ends with the block that comes closest to the
source's share of the budget. ``mix_order`` in 0..1 is the place in the mixture: sorted by
it, all sources advance at the pace of their weights.

A hot source is only ever summed up (map-side first); the window runs over blocks, at
most ``BLOCKS`` per source and pass. The plan of taken blocks is broadcast to the documents,
which then stay in their tasks, if it has at most ``SMALL`` rows; a larger one, of thousands
of sources, is joined, where Spark splits blocks that are too full.

Tokens are white-space words plus one, so that an empty or null text has one. A null
source is a source of its own. Repeated rows fall into one block and are kept. Empty
input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

BLOCKS = 1024
PROBES = 32
#: Rows of a plan that is broadcast, some megabytes.
SMALL = 1 << 17
ENTROPY = 0.95
MAX_PASSES = 2.0
SEED = 11

TOKENS = r"CAST(size(array_remove(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), '')) + 1 AS LONG)"


def _bisect(sources: DataFrame, good: str, tolerance: float = 1e-9) -> float:
    """The smallest exponent in 0..1 at which ``good`` holds, a condition on h and r.

    It must hold from some exponent up to 1. ``h``: entropy as a share of the largest one;
    ``r``: passes of the most repeated source when the least repeated one has one pass.
    """
    low, high = 0.0, 1.0
    while high - low > tolerance:
        probes = [low + (high - low) * i / PROBES for i in range(PROBES + 1)]
        rows = (
            sources.select("log_share", F.posexplode(F.lit(probes)).alias("i", "a"))
            .groupBy("i").agg(
                F.count("*").alias("n"),
                F.sum(F.expr("exp(a * log_share)")).alias("z"),
                F.sum(F.expr("exp(a * log_share) * a * log_share")).alias("e"),
                F.expr("exp(max((a - 1) * log_share) - min((a - 1) * log_share))").alias("r"),
            )
            .withColumn("h", F.expr("IF(n = 1, 1D, (ln(z) - e / z) / ln(n))"))
            .where(good).select("i").collect()  # at most PROBES + 1 rows
        )
        first = min((row.i for row in rows), default=PROBES)
        if first == 0:
            return probes[0]
        low, high = probes[first - 1], probes[first]
    return high


def temperature(sources: DataFrame, entropy: float, max_passes: float) -> float:
    """Exponent for a table of sources with ``log_share``.

    Entropy falls as the exponent grows, so the target is met by the largest exponent
    that keeps it: one minus the smallest share of flattening.
    """
    flat = _bisect(sources, f"h <= {entropy!r}D")
    return max(flat, _bisect(sources, f"r <= {max_passes!r}D * (1 + 1e-12)"))


def mix(
    docs: DataFrame,
    entropy: float = ENTROPY,
    max_passes: float = MAX_PASSES,
    budget_tokens: int | None = None,
    tokens: str = TOKENS,
) -> DataFrame:
    """All columns of ``docs`` per pass of a document, and ``mix_tokens, mix_pass, mix_block, mix_order``.

    ``text``, ``source`` and ``doc_id`` are read. Columns with the added names are replaced.
    """
    added = ("mix_tokens", "mix_pass", "mix_block", "mix_order", "__mix_source", "__mix_taken", "__mix_row")
    scratch = Scratch(docs.sparkSession, "mix")
    base = docs.drop(*added).withColumn("mix_tokens", F.expr(tokens)).withColumn(
        "__mix_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    ).withColumn("mix_block", F.expr(f"CAST(pmod(xxhash64(doc_id, text), {BLOCKS}) AS INT)"))
    blocks = scratch.save(
        base.groupBy("__mix_source", "mix_block").agg(F.sum("mix_tokens").alias("tokens")), "blocks"
    )
    sources = blocks.groupBy("__mix_source").agg(F.sum("tokens").alias("tokens"))
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total:
        return base.select(
            *docs.drop(*added).columns, "mix_tokens", F.lit(0).alias("mix_pass"), "mix_block",
            F.lit(0.0).alias("mix_order"),
        )
    sources = scratch.save(
        sources.withColumn("log_share", F.log(F.col("tokens") / F.lit(float(total)))), "sources"
    )
    a = temperature(sources, entropy, max_passes)
    weight = F.exp(a * F.col("log_share"))
    sums = sources.agg(
        F.sum(weight).alias("z"), F.max(F.col("tokens") / weight).alias("least")
    ).first()
    # ``least`` * z: budget at which the source with the fewest passes has one.
    budget = float(budget_tokens) if budget_tokens is not None else sums.least * sums.z
    passes = F.greatest(weight * budget / sums.z / F.col("tokens"), F.lit(0.0))
    wanted = sources.select(
        "__mix_source", "tokens", F.when(F.abs(passes - F.round(passes)) < 1e-6, F.round(passes))
        .otherwise(passes).alias("passes"),
    )
    # Passes of a block: all full ones, and the last one if the block comes early enough in it.
    per_pass = blocks.withColumnRenamed("tokens", "own").join(wanted, "__mix_source").withColumn(
        "mix_pass", F.explode(F.expr("sequence(0, CAST(greatest(ceil(passes), 1) AS INT) - 1)"))
    ).withColumn("place", F.xxhash64("__mix_source", "mix_block", "mix_pass", F.lit(SEED)))
    order = Window.partitionBy("__mix_source", "mix_pass").orderBy("place", "mix_block")
    placed = per_pass.withColumn(
        "before", F.coalesce(F.sum("own").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    # A block of the last pass is taken if more than half of it lies within the budget.
    placed = scratch.save(
        placed.where("mix_pass + (before + own / 2.0D) / tokens <= passes")
        .select("__mix_source", "mix_block", "mix_pass",
                F.expr("(mix_pass + before / tokens) / passes").alias("mix_order")), "plan",
    )
    taken = placed.groupBy("__mix_source", "mix_block").agg(
        F.sort_array(F.collect_list(F.struct("mix_pass", "mix_order"))).alias("__mix_taken")
    )
    if placed.count() <= SMALL:
        taken = F.broadcast(taken)
    return (
        base.join(taken, ["__mix_source", "mix_block"])
        .select(*docs.drop(*added).columns, "mix_tokens", "mix_block", F.explode("__mix_taken").alias("__mix_row"))
        .select("*", "__mix_row.mix_pass", "__mix_row.mix_order").drop("__mix_row")
    )
