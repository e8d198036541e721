"""Near-duplicates by MinHash with a signature-coordinate inverted join.

1. Every whole text becomes the set of its distinct 5-word shingles (64-bit hashes)
   and ``COORDINATES`` signature coordinates, each of them ``MINIMA`` minimum hashes
   taken together. Documents that merely share a line or a passage seldom agree in
   several minima at once, so frequent passages make no long posting lists.
   Documents of equal sets form one class, which its smallest id represents; only
   representatives go on.
2. A representative is posted under each (coordinate, value) pair; pairs held by
   one representative only cannot collide and are dropped. Two signatures match if
   they collide in at least ``MATCHES`` coordinates. A representative with s shared
   pairs needs s - MATCHES + 1 postings to meet all its partners, if all take their
   rarest pairs first (prefix filter); one with s < MATCHES has no partner.
3. Of each such representative the shingles that another one has too are counted: no
   intersection is larger, which skips documents and pairs whose sets cannot be
   similar enough, exactly. The last step counts them in ``PARTS`` parts of the hash
   range: two sets have no more in common than the sum of the lesser counts.
4. Postings are merged with skips. In each round every posting list names ``LEADERS``
   pivots, and each member is compared with the pivots that most of its lists name, unless
   both are already known to be connected or their sizes are too far apart. Between rounds
   labels move over two links only; components are followed to the end once, after the last. What is left are pairs across components: the
   lists in one component are skipped, in the others each member outside the list's
   largest component meets the members of other components, in the first list that both
   hold only and if their signatures match. Rounds of pivots are
   repeated while that rest is large and shrinks. So a group of thousands of
   near copies costs a few comparisons per member, and yet every matching pair is
   either compared or inside one component.
5. A compared pair is linked if its signatures match and its full shingle sets pass
   ``100 * intersection >= 75 * union``. Components get their smallest id by label
   propagation with path shortcuts over tables in the shared folder.

``MATCHES`` of 3 in 40 coordinates of 3 minima misses a pair at the similarity limit
with a probability of about 1.4e-7, and far less above it. Before the full sets of a pair are brought
together, the sizes and the lowest 16 bits of all shingles rule out what cannot pass.

Whole texts are read again twice, to pick the ones with a partner and the ones that stay.
Ids hashed to at most ``BITS`` bits tell first which rows can be concerned, so that the
other texts are not shuffled for it; then ids are joined exactly.

Null or empty texts and texts without words have no set and are linked with nothing.
Rows of a null id are returned as their own (``component_id`` null, kept). Rows that
share an id count as one document. Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, pick
from .textscan import LOWER, factors, mix, slices, word_hashes, words

SHINGLE = 5
COORDINATES = 40
#: Minimum hashes that make one coordinate.
MINIMA = 3
MATCHES = 3
#: Comparisons across components, per posting, that are made without another round of pivots.
REST = 16
#: Parts of the hash range in which shingles that others share are counted.
PARTS = 32
#: Pivots that a list names in one round, and pivots that a member is compared with.
LEADERS = 4
PIVOTS = 8
#: Bits that tell which ids can be among others, broadcast in at most ``BITS`` / 64 rows.
BITS = 1 << 24

_WORD = factors(SHINGLE, 21)
_XOR, _MULTIPLY = factors(COORDINATES * MINIMA, 22), factors(COORDINATES * MINIMA, 23)
_TOGETHER = factors(MINIMA, 25)
_CHECKS = factors(2, 24)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order of the rows, and each row's first (one more at the end)."""
    data = LOWER[data]
    starts, ends, per_row = words(data, offsets)
    h = word_hashes(data, starts, ends)
    n = np.diff(per_row)
    made = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(made)])
    if not len(h):
        return np.empty(0, np.uint64), first
    row = np.repeat(np.arange(len(n)), made)
    at = per_row[row] + np.arange(len(row)) - first[row]
    size = np.minimum(n[row], SHINGLE)
    total = size.astype(np.uint64)
    for k in range(SHINGLE):
        term = h[np.minimum(at + k, len(h) - 1)] * _WORD[k]
        total += np.where(k < size, term, np.uint64(0))
    return mix(total), first


def _distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values per row, and each row's first."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values = values[new]
    return values, np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(first) - 1))])


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64)))


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, size and two checksums of the shingle set, the coordinate-value pairs (none for an empty set)."""
    for batch in batches:
        for i, j, data, offsets in slices(batch.column(1)):
            values, first = _distinct(*shingles(data, offsets))
            n = np.diff(first)
            some = np.flatnonzero(n)
            checks = [np.zeros(j - i, np.int64) for _ in _CHECKS]
            pairs = np.empty((len(some), COORDINATES), np.uint64)
            if len(some):
                for c, f in zip(checks, _CHECKS, strict=True):
                    c[some] = np.add.reduceat(mix(values * f), first[some]).view(np.int64)
                for k in range(COORDINATES):
                    value = np.zeros(len(some), np.uint64)
                    for m in range(MINIMA):
                        h = (values ^ _XOR[k * MINIMA + m]) * _MULTIPLY[k * MINIMA + m]
                        value += np.minimum.reduceat(h, first[some]) * _TOGETHER[m]
                    pairs[:, k] = (mix(value) & ~np.uint64(63)) | np.uint64(k)
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, COORDINATES, 0))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array(n), *(pa.array(c) for c in checks),
                 _lists(pairs.ravel(), ends)],
                names=["doc_id", "n_shingles", "check1", "check2", "pairs"],
            )


def _brief(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Per row the lowest 16 bits of its values, told apart by how often each occurred before.

    Common elements of two rows are at most as many as the common numbers here.
    """
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key = np.sort((row << 16) | (values & np.uint64(0xFFFF)).astype(np.int64))
    again = np.arange(len(key)) - np.searchsorted(key, key)
    brief = ((key & 0xFFFF) | (again << 16)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(brief))


def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in slices(batch.column(1)):
            values, first = _distinct(*shingles(data, offsets))
            part = (values.view(np.int64) & (PARTS - 1)) + PARTS * np.repeat(np.arange(j - i), np.diff(first))
            counts = np.bincount(part, minlength=PARTS * (j - i)).astype(np.int32)
            parts = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * PARTS, pa.int32()), pa.array(counts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), _lists(values, first), _brief(values, first), parts],
                names=["node", "shingles", "brief", "parts"],
            )


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, comp) with the smallest node of each component; ``edges`` has columns a, b."""
    both = scratch.save(
        edges.select("a", "b").unionAll(edges.select("b", "a")).where("a <> b").distinct().toDF("a", "b"), "edges"
    )
    labels = scratch.save(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "labels"
    )
    while True:
        near = (
            both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("near"))
        )
        lower = labels.join(near, labels.node == near.a).select(
            "node", "comp", F.least("comp", "near").alias("next")
        )
        # Shortcut: the label of the label.
        jump = labels.select(F.col("node").alias("at"), F.col("comp").alias("far"))
        after = scratch.save(
            lower.join(jump, lower.next == jump["at"], "left").select(
                "node", F.least("next", "far").alias("comp"),
                (F.least("next", "far") < F.col("comp")).alias("moved"),
            ), "labels",
        )
        moved = after.where("moved").limit(1).count()
        scratch.drop(labels)
        labels = after
        if not moved:
            scratch.drop(both)
            return labels.select("node", "comp")


def repeated_ids(rows: DataFrame) -> DataFrame:
    """The ids of more than one row; usually there are none, and then nothing needs a shuffle to make rows unique."""
    return rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")


def told_apart(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` whose ``doc_id`` can be among ``ids``, and those whose surely is not."""
    hashed = F.xxhash64(F.col("doc_id").cast("long"))
    bits = ids.select(hashed.alias("h")).groupBy(F.expr(f"pmod(h, {BITS}) div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(pmod(h, 64) AS INT))")).alias("bits"))
    own = F.xxhash64(docs["doc_id"].cast("long"))
    word = F.floor(F.pmod(own, F.lit(BITS)) / 64)
    marked = docs.join(F.broadcast(bits), word == bits["word"], "left")
    at = F.pmod(own, F.lit(64)).cast("int")
    can = F.coalesce(F.getbit(bits["bits"], at) == 1, F.lit(False))
    columns = [docs[f"`{c}`"] for c in docs.columns]
    return marked.where(can).select(columns), marked.where(~can).select(columns)


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is one of the ``ids``."""
    return told_apart(docs, ids)[0].join(ids, "doc_id", "left_semi").select(docs.columns)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The other rows of ``docs``."""
    can, cannot = told_apart(docs, ids)
    return cannot.unionAll(can.join(ids, "doc_id", "left_anti").select(docs.columns))


def link(docs: DataFrame, shingle_percent: int = 75) -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id, kept``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    docs = pick(docs, {"doc_id": "long", "text": "string"})
    signed = scratch.save(docs.mapInArrow(
        signatures, "doc_id long, n_shingles long, check1 long, check2 long, pairs array<long>"
    ), "signatures")

    # Classes of equal sets; a class is named by its smallest id.
    key = ["check1", "check2", "n_shingles"]
    named = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = scratch.save(named.groupBy(*key).agg(F.min("doc_id").alias("node")), "classes")
    heads = named.join(
        classes.select(F.col("node").alias("doc_id"), *key), ["doc_id", *key], "left_semi"
    ).select(F.col("doc_id").alias("node"), "n_shingles", "pairs")

    # Shared coordinate-value pairs with their number of holders, rarest first.
    posted = scratch.save(heads.select("node", "n_shingles", F.explode("pairs").alias("pair")), "postings")
    held = posted.groupBy("pair").agg(F.count("*").alias("n")).where("n > 1")
    partners = scratch.save(
        posted.join(held, "pair").groupBy("node")
        .agg(
            F.sort_array(F.collect_set(F.struct("n", "pair"))).alias("by_rarity"),  # at most COORDINATES
            F.min("n_shingles").alias("least"), F.max("n_shingles").alias("size"),
        )
        .where(F.size("by_rarity") >= MATCHES)
        .select(
            "node", "least", "size", F.col("by_rarity.pair").alias("pairs"),
            F.expr(f"slice(by_rarity.pair, 1, size(by_rarity) - {MATCHES} + 1)").alias("prefix"),
        ), "partners",
    )
    scratch.drop(posted)
    # Full sets of the representatives that have a partner to be compared with.
    sets = among(docs, partners.select(F.col("node").alias("doc_id"))).mapInArrow(shingle_sets, "node long, shingles array<long>, brief array<int>, parts array<int>")
    if not repeated_ids(signed).isEmpty():
        sets = sets.dropDuplicates(["node"])
    sets = scratch.save(sets, "sets")
    # A set cannot have more in common with another than the shingles that some other set holds.
    alone = (
        sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle")
        .agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
        .groupBy("node", F.expr(f"CAST(shingle & {PARTS - 1} AS INT)").alias("part")).agg(F.count("*").alias("n"))
        .groupBy("node").agg(  # at most PARTS entries
            F.sum("n").alias("alone"), F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("by_part"))
    )
    alone = scratch.save(alone, "alone")
    shared = sets.select("node", "parts").join(alone, "node", "left").select(
        "node", F.expr("transform(parts, (n, i) -> n - coalesce(by_part[i], 0))").alias("parts"))
    lists = scratch.save(
        partners.join(alone, "node", "left").withColumn("most", F.expr("size - coalesce(alone, 0)"))
        .where(f"100 * most >= {shingle_percent} * least")
        .select("node", "least", "most", F.explode("prefix").alias("pair")), "prefix",
    )

    def confirm(pairs: DataFrame) -> DataFrame:
        """The links among the pairs (a, b): those whose signatures match and whose full sets are similar enough.

        ``n`` collisions of a pair are counted already, outside the prefixes there may be more.
        """
        signed_a = partners.select(F.col("node").alias("a"), F.col("pairs").alias("pa"))
        signed_b = partners.select(F.col("node").alias("b"), F.col("pairs").alias("pb"))
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        pairs = scratch.save(pairs.select("a", "b", "n"), "compared")
        matching = pairs.where(F.col("n") >= MATCHES).select("a", "b").unionAll(
            pairs.where(F.col("n") < MATCHES).join(signed_a, "a").join(signed_b, "b")
            .where(F.expr(f"size(array_intersect(pa, pb)) >= {MATCHES}")).select("a", "b")
        )
        enough = f"100 * common >= {shingle_percent} * (size(sa) + size(sb) - common)"
        common = F.expr("size(array_intersect(sa, sb))")
        # First by a quarter of the bytes, which never counts too few; then in full.
        brief_a = sets.select(F.col("node").alias("a"), F.col("brief").alias("sa"))
        brief_b = sets.select(F.col("node").alias("b"), F.col("brief").alias("sb"))
        likely = scratch.save(
            matching.join(brief_a, "a").join(brief_b, "b").withColumn("common", common).where(enough).select("a", "b"),
            "likely",
        )
        links = scratch.save(
            likely.join(left, "a").join(right, "b").withColumn("common", common).where(enough).select("a", "b"), "links"
        )
        scratch.drop(pairs, likely)
        return links

    def may_match(least_a: str, most_a: str, least_b: str, most_b: str) -> Column:
        """Sets of these sizes with at most so many elements in common with others can be similar enough."""
        common = f"least({most_a}, {most_b})"
        return F.expr(f"100 * {common} >= {shingle_percent} * ({least_a} + {least_b} - {common})")

    def united(links: list[DataFrame]) -> DataFrame:
        known = links[0]
        for more in links[1:]:
            known = known.unionAll(more)
        return known

    def between(known: DataFrame, labels: DataFrame) -> DataFrame:
        """The links as links of different labels."""
        a, b = labels.toDF("a", "ca"), labels.toDF("b", "cb")
        return known.join(a, "a").join(b, "b").where("ca <> cb").select("ca", "cb").distinct()

    def relabel(known: DataFrame, labels: DataFrame) -> DataFrame:
        """Smallest labels within two links. Nodes of one label are connected; the reverse need not hold yet."""
        one_way = between(known, labels)
        both = scratch.save(one_way.unionAll(one_way.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"))), "hops")
        near = both.groupBy("ca").agg(F.least(F.min("cb"), F.col("ca")).alias("low")).toDF("cb", "low")
        lower = both.join(near, "cb").groupBy(F.col("ca").alias("comp")).agg(F.min("low").alias("low"))
        after = scratch.save(
            labels.join(lower, "comp", "left").select("node", F.coalesce("low", "comp").alias("comp")), "labels")
        scratch.drop(both, labels)
        return after

    labels = scratch.save(lists.select("node", F.col("node").alias("comp")).distinct(), "labels")
    at = lists.withColumn("comp", F.col("node"))
    postings = lists.count()
    linked = []
    turn, last = 0, None
    while postings:
        turn += 1
        leaders = at.groupBy("pair").agg(*(
            F.min(F.struct(F.xxhash64("node", F.lit(turn * LEADERS + k)).alias("h"), "node", "comp", "least", "most"))
            .alias(f"p{k}") for k in range(LEADERS)
        ))
        pivots = leaders.select("pair", F.explode(F.array_distinct(F.array(*(
            F.expr(f"struct(p{k}.node, p{k}.comp, p{k}.least, p{k}.most)") for k in range(LEADERS)
        )))).alias("p"))
        most = Window.partitionBy("a").orderBy(F.desc("n"), "b")
        meets = (
            at.join(pivots, "pair").where("comp <> p.comp").where(may_match("least", "most", "p.least", "p.most"))
            .groupBy(F.col("node").alias("a"), F.col("p.node").alias("b")).agg(F.count("*").alias("n"))
            .withColumn("nth", F.row_number().over(most)).where(F.col("nth") <= PIVOTS)  # of COORDINATES * LEADERS
        )
        found = confirm(meets)
        linked.append(found)
        gained = found.limit(1).count()
        now = at
        if gained:
            labels = relabel(united(linked), labels)
            now = scratch.save(lists.join(labels, "node"), "round")
            if turn > 1:
                scratch.drop(at)
        # What is left: members outside the largest component of their list.
        by_comp = now.groupBy("pair", "comp").agg(F.count("*").alias("n"))
        per_list = by_comp.groupBy("pair").agg(
            F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("most")
        ).where("all > most.n").select("pair", "all", F.col("most.comp").alias("largest"), F.col("most.n").alias("n"))
        rest = per_list.agg(F.sum(F.expr("(all - n) * all"))).first()[0] or 0
        at = now
        if rest > REST * postings and gained and (last is None or 4 * rest < 3 * last):
            last = rest
            continue
        if rest:
            # Wide columns only for members of the lists that are left.
            now = now.join(per_list.select("pair"), "pair", "left_semi")
            now = now.join(shared, "node").join(partners.select("node", "pairs"), "node")
            outside = now.join(per_list, "pair").where("comp <> largest").select(
                "pair", "largest", F.col("node").alias("a"), F.col("comp").alias("a_comp"),
                F.col("least").alias("a_least"), F.col("most").alias("a_most"), F.col("parts").alias("a_parts"),
                F.col("pairs").alias("a_pairs"))
            prefixes = (f"slice({p}, 1, size({p}) - {MATCHES} + 1)" for p in ("a_pairs", "pairs"))
            common = "aggregate(zip_with(a_parts, parts, (x, y) -> least(x, y)), 0L, (x, y) -> x + y)"
            across = (
                outside.join(now.withColumnRenamed("node", "b"), "pair").where("comp <> a_comp")
                .where("comp = largest OR a < b")  # of two outside, once
                .where(may_match("a_least", "a_most", "least", "most"))
                # Two members meet in every list that both hold and come out in the first of them only.
                .where(f"array_min(array_intersect({', '.join(prefixes)})) = pair")
                .where(f"size(array_intersect(a_pairs, pairs)) >= {MATCHES}")
                .where(f"100 * {common} >= {shingle_percent} * (a_least + least - {common})")
                .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(MATCHES).alias("n"))
            )
            linked.append(confirm(across))
        break

    # Nothing below reads them; with ``linked`` and ``labels`` the links are known.
    scratch.drop(sets, alone, partners, lists)
    result = classes
    if linked:
        # Labels stand for their nodes, so few links are left to follow.
        merged = components(scratch, between(united(linked), labels).toDF("a", "b")).toDF("comp", "least")
        final = labels.join(merged, "comp", "left").select("node", F.coalesce("least", "comp").alias("comp"))
        result = classes.join(final, "node", "left")
    else:
        result = classes.withColumn("comp", F.lit(None).cast("long"))
    result = result.select(*key, F.coalesce("comp", "node").alias("component"))
    return (
        signed.join(result, key, "left")
        .select("doc_id", "n_shingles", F.coalesce(
            F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with the smallest id of each component only, once; all columns unchanged."""
    linked = Scratch(docs.sparkSession, "near").save(link(docs), "linked")
    gone = linked.where("NOT kept").select("doc_id").distinct()
    rest = without(docs, gone)
    # Rows that share an id are one document.
    repeated = repeated_ids(linked)
    if repeated.isEmpty():
        return rest
    return without(rest, repeated).unionAll(among(rest, repeated).dropDuplicates(["doc_id"]))
