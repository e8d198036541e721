"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` cells. Each shard owns ``VIRTUAL_NODES`` of them as
virtual nodes; a document falls into a cell by the hash of its id and belongs to
the first virtual node clockwise. Loads are bounded: with n documents and s
shards, ``n mod s`` shards may hold one document more than ``n div s``, the others
``n div s``. A shard takes the documents of its own arcs until it is full; what is
left over continues clockwise to the next virtual nodes whose shards have room.
The bounds add up to n, so counts end at most one apart (law ``rows``), and only
the overflow leaves its place on the ring.

The walk needs the number of documents per arc only (at most ``shards *
VIRTUAL_NODES`` numbers, whatever the input). It gives intervals of ranks within
an arc, to which documents are then joined by their rank. Ranks are counted in
small pieces of each arc, so that no task holds a whole arc even if one id
holds a third of all rows.

Nulls: a null id hashes like any other key, a null text has size 1 and the
checksum of the empty text. Repeated rows are placed one by one. Empty input
gives an empty result; with fewer documents than shards some stay empty.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, pick

CELLS = 1 << 12
VIRTUAL_NODES = 64
#: Documents that one task ranks.
PIECE_ROWS = 100_000


def ring(spark: SparkSession, shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes in clockwise order; a taken cell passes to the next free one."""
    if shards * virtual_nodes > CELLS:
        virtual_nodes = max(1, CELLS // shards)
    wanted = (
        spark.range(shards * virtual_nodes)
        .select(
            F.expr(f"CAST(id % {shards} AS INT)").alias("shard"),
            F.expr(f"CAST(pmod(xxhash64(id % {shards}, id div {shards}), {CELLS}) AS INT)").alias("cell"),
        )
        .orderBy("shard", "cell").collect()
    )
    taken: dict[int, int] = {}
    for row in wanted:
        cell = row.cell
        while cell in taken:
            cell = (cell + 1) % CELLS
        taken[cell] = row.shard
    return sorted(taken.items())


def place(counts: list[int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Intervals (arc, first rank, rank after the last, shard, first slot).

    ``counts`` and ``owners`` hold the documents and the shard of each arc in
    clockwise order.
    """
    n = sum(counts)
    room = [n // shards + (s < n % shards) for s in range(shards)]
    used = [0] * shards
    out: list[tuple[int, int, int, int, int]] = []

    def take(arc: int, start: int, shard: int, most: int) -> int:
        got = min(most, room[shard] - used[shard])
        if got:
            out.append((arc, start, start + got, shard, used[shard]))
            used[shard] += got
        return start + got

    at_home = [take(a, 0, owners[a], counts[a]) for a in range(len(counts))]
    for arc, start in enumerate(at_home):
        step = 1
        while start < counts[arc]:
            start = take(arc, start, owners[(arc + step) % len(owners)], counts[arc] - start)
            step += 1
    return out


def _table(spark: SparkSession, rows: list[tuple], schema: str, names: list[str]) -> DataFrame:
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    nodes = ring(spark, shards)
    # Cell -> number of the first virtual node clockwise, as a literal array.
    arc_of, arc = [], 0
    for cell in range(CELLS):
        while arc < len(nodes) and nodes[arc][0] < cell:
            arc += 1
        arc_of.append(arc % len(nodes))
    df = pick(docs, {"doc_id": "long", "text": "string"})
    text = F.coalesce("text", F.lit(""))
    keyed = scratch.save(df.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.get(F.lit(arc_of), F.expr(f"CAST(pmod(xxhash64(doc_id), {CELLS}) AS INT)")).alias("arc"),
        F.monotonically_increasing_id().alias("row"),
    ), "keys")
    per_arc = {r.arc: r["count"] for r in keyed.groupBy("arc").count().collect()}
    counts = [per_arc.get(a, 0) for a in range(len(nodes))]
    pieces = max(1, max(counts) // PIECE_ROWS + 1)
    keyed = keyed.withColumn("piece", F.expr(f"CAST(pmod(xxhash64(row), {pieces}) AS INT)"))
    before = Window.partitionBy("arc").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("arc", "piece").agg(F.count("*").alias("n")).select(
        "arc", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
    )
    in_piece = Window.partitionBy("arc", "piece").orderBy("row")
    ranked = (
        keyed.withColumn("rank", F.row_number().over(in_piece) - 1)
        .join(starts, ["arc", "piece"])
        .withColumn("rank", F.col("rank") + F.col("before"))
    )
    intervals = _table(
        spark, place(counts, [s for _, s in nodes], shards),
        "arc int, low long, high long, shard int, slot long",
        ["arc", "low", "high", "shard", "slot"],
    )
    homes = _table(spark, [(a, s) for a, (_, s) in enumerate(nodes)],
                   "arc int, home_shard int", ["arc", "home_shard"])
    # Both have at most a few intervals per virtual node, whatever the input.
    return (
        ranked.join(F.broadcast(intervals.withColumnRenamed("arc", "of")),
                    F.expr("arc = of AND rank >= low AND rank < high"))
        .join(F.broadcast(homes), "arc")
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
            (F.col("slot") + F.col("rank") - F.col("low")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "home_shard",
        )
    )
