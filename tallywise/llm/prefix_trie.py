"""Conversation prefix trie by the Euler-tour technique.

A node of depth d stands for the first d turns (role, text) of the conversations that
start with them, its members; the root of depth 0 has all.

1. Turns are ranked over the whole table. A prefix is named by its depth and the
   exclusive or of 128-bit hashes of its turns with their places, a running total over
   ranks, so a conversation of any length needs no task of its own. Members are counted
   in the tasks before they are shuffled.
2. Nodes are numbered by (depth, parent, smallest member), so that siblings follow each
   other, again as ranks: the children of one node may be any number. Every node has
   an enter and an exit arc. Enter is followed by the first child's enter or else the
   own exit, exit by the next sibling's enter or else the parent's exit.
3. The tour is list-ranked by taking out independent arcs round by round
   (``order.list_ranks``); with places known, leaves and savings are running totals over
   the tour, and what a subtree holds is the difference between its exit and its enter.

Two prefixes share a name with a probability of about 2^-128 times the number of pairs.

Turns come in the order of ``turn``, null first; equal turns by a hash of role and text.
Null roles and texts become empty. Rows of a null conversation take no part; repeated
rows are turns of their own. Very long texts are hashed and counted whole. Extra
columns are ignored, whatever their names. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick
from .order import LIMIT, list_ranks, ranked, running

#: Ids that are joined to one text before it is hashed.
PORTION = 4096
#: Turns of another conversation that ``rebuild`` takes at most, plus 1; distance of its ids.
HEADS, FAMILY = 6, 100

_TURNS = {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}


def _ordered(scratch: Scratch, turns: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """Turns with ``rank``, two hashes and length of the turn; first rank and number of turns per conversation."""
    filled = pick(turns, _TURNS).where("conv_id IS NOT NULL").withColumns(
        {c: F.coalesce(c, F.lit("")) for c in ("role", "text")}
    )
    hashed = filled.select(
        "conv_id", "turn", F.expr("xxhash64(1, role, text)").alias("d1"), F.expr("xxhash64(2, role, text)").alias("d2"),
        F.length("text").cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"), *more,
    )
    # ``row`` tells equal rows apart, which may be many.
    ordered = ranked(scratch, hashed, ("conv_id", "turn", "d1", "d2", "row"), "rank").drop("turn", "row")
    spans = ordered.groupBy("conv_id").agg(F.min("rank").alias("first"), F.count("*").alias("n_turns"))
    return ordered, scratch.save(spans, "spans")


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns ``conv_id, turn, role, text``, all ``conv_id``) of conversations that share their heads.

    Conversation c gets the first h turns of conversation c - c % 100 and then its own
    turns after the first h, where h = crc32(c) % 6.
    """
    scratch = Scratch(conversations.sparkSession, "rebuild")
    ordered, spans = _ordered(scratch, conversations, "role", "text")
    spans = spans.withColumn("h", F.expr(f"crc32(CAST(CAST(conv_id AS STRING) AS BINARY)) % {HEADS}")).withColumn(
        "base", F.expr(f"conv_id - conv_id % {FAMILY}"))
    sizes = spans.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("base_turns"))
    spans = scratch.save(spans.join(sizes, "base", "left").withColumn("n_head", F.expr("least(h, coalesce(base_turns, 0))")), "heads")
    own = ordered.join(spans, "conv_id").where("rank - first >= h").select(
        "conv_id", F.expr("n_head + rank - first - h + 1").alias("turn"), "role", "text")
    heads = ordered.join(spans.where("conv_id = base"), "conv_id").where(f"rank - first < {HEADS - 1}").select(
        F.col("conv_id").alias("base"), F.expr("rank - first").alias("at"), "role", "text")
    # At most FAMILY conversations take at most HEADS - 1 turns of one.
    taken = spans.select("conv_id", "base", "n_head").join(heads, "base").where("at < n_head").select(
        "conv_id", F.expr("at + 1").alias("turn"), "role", "text")
    return own.unionAll(taken), spans.select("conv_id")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the portions of each node, which come in order."""
    now, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    done: list[pa.RecordBatch] = []
    for batch in batches:
        for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node != now:
                if state:
                    done.append(row())
                now, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
            done = []
    if state:
        yield row()


def build_trie(turns: DataFrame, members: DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``.

    ``members`` (``conv_id``) adds conversations without turns. ``saved_tokens`` counts
    what members after the first need not store in the node's subtree, in code points.
    """
    scratch = Scratch(turns.sparkSession, "trie")
    ordered, spans = _ordered(scratch, turns)
    located = scratch.save(ordered.join(spans, "conv_id").withColumn("depth", F.expr("rank - first + 1")).select(
        "conv_id", "rank", "depth", "n_turns", "chars",
        F.expr("xxhash64(3, depth, d1, d2)").alias("g1"), F.expr("xxhash64(4, depth, d1, d2)").alias("g2"),
    ), "located")
    summed = scratch.save(running(scratch, located, "rank", ("g1", "g2"), located.count(), "bit_xor"), "summed")
    starts = summed.where("depth = 1").select(
        "conv_id", F.expr("running_g1 ^ g1").alias("s1"), F.expr("running_g2 ^ g2").alias("s2"))
    named = scratch.save(summed.join(starts, "conv_id").select(
        "conv_id", "depth", "n_turns", "chars",
        F.expr("running_g1 ^ s1").alias("k1"), F.expr("running_g2 ^ s2").alias("k2"),
        F.expr("running_g1 ^ s1 ^ g1").alias("p1"), F.expr("running_g2 ^ s2 ^ g2").alias("p2"),
    ), "named")

    everyone = spans.select("conv_id")
    if members is not None:
        everyone = everyone.unionAll(pick(members, {"conv_id": "long"}).where("conv_id IS NOT NULL")).distinct()
        everyone = scratch.save(everyone, "everyone")
    zero = F.lit(0).cast("long")
    root = everyone.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("chars"), zero.alias("p1"), zero.alias("p2"))
    nodes = scratch.save(named.groupBy("depth", "k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        *(F.min(c).alias(c) for c in ("chars", "p1", "p2")),
    ).unionAll(root), "nodes")

    above = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    numbered = scratch.save(ranked(
        scratch, nodes.join(above, ["depth", "p1", "p2"], "left").drop("p1", "p2"), ("depth", "parent_conv_id", "conv_id"), "node"
    ), "numbered")
    children = numbered.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id")
    ).agg(F.min("node").alias("first_child"), F.max("node").alias("last_child"), F.count("*").alias("n_children"))
    parents = scratch.save(numbered.join(children, ["depth", "conv_id"], "left"), "parents")
    above = parents.select(
        (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"),
        F.col("node").alias("parent"), F.col("last_child").alias("last_sibling"))
    tree = scratch.save(parents.join(above, ["depth", "parent_conv_id"], "left").select(
        "node", "depth", "k1", "k2", "conv_id", "parent_conv_id", "n_convs",
        F.coalesce("n_children", zero).alias("n_children"), "first_child", "parent",
        (F.col("node") == F.col("last_sibling")).alias("is_last"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
        F.expr("(n_convs - 1) * chars").alias("saved"),
    ), "tree")

    # Arc 2 * node enters the node, arc 2 * node + 1 leaves it.
    arcs = tree.select(F.inline(F.expr("""array(
        struct(2 * node AS arc, coalesce(2 * first_child, 2 * node + 1) AS next),
        struct(2 * node + 1 AS arc, CASE WHEN is_last THEN 2 * parent + 1 WHEN parent IS NOT NULL THEN 2 * node + 2 END AS next)
    )""")))
    places, size = list_ranks(scratch, arcs, limit)
    enters = F.col("arc") % 2 == 0
    tour = scratch.save(
        places.withColumn("node", F.expr("arc div 2")).join(tree.select("node", "leaves", "saved"), "node").select(
            "node", "place", enters.alias("enters"),
            *(F.when(enters, F.col(c)).otherwise(zero).alias(c) for c in ("leaves", "saved")),
        ), "tour",
    )
    sums = running(scratch, tour, "place", ("leaves", "saved"), size)
    held = sums.groupBy("node").agg(*(
        F.sum(F.when(F.col("enters"), F.col(c) - F.col(f"running_{c}")).otherwise(F.col(f"running_{c}"))).alias(f"sub_{c}")
        for c in ("leaves", "saved")
    ))

    # Conversations that end at a node, by id.
    ends = named.where("depth = n_turns").select("depth", "k1", "k2", F.col("conv_id").alias("ended")).join(
        tree.select("depth", "k1", "k2", "node"), ["depth", "k1", "k2"]).select("node", "ended")
    if members is not None:
        turnless = everyone.join(spans, "conv_id", "left_anti")
        ends = ends.unionAll(turnless.select(zero.alias("node"), F.col("conv_id").alias("ended")))
    portions = ranked(scratch, ends, ("node", "ended"), "rank").groupBy("node", F.expr(f"rank div {PORTION}").alias("portion")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("ended")), lambda x: x.cast("string")), ",").alias("ids"))
    hashed = portions.repartition("node").sortWithinPartitions("node", "portion").select("node", "ids").mapInArrow(
        _digest, "node long, ends_sha256 string")
    return tree.join(held, "node").join(hashed, "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("sub_leaves").alias("n_leaves"),
        F.col("sub_saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
