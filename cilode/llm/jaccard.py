"""Joining texts whose word n-grams are alike, by vertical partitioning.

The global order of all n-grams is that of their 64-bit hashes. It is cut into fragments of
equal width; a text's set falls into one segment per fragment.

Two sets of at most n members whose Jaccard similarity reaches the threshold differ in at
most K(n) members. With more than K(n) fragments, some segments are therefore the same in
both, and the pair is found as two equal segments of one fragment. The number of fragments
is a power of two that goes with the size of a set; a text whose partners may be large
enough for the next power takes part in both. No pair is lost: empty segments, which are
equal without saying anything, are reckoned with, and take part themselves where there are
too many of them.

A pair's overlap is then counted for each fragment on its own and summed. Parities of the
fragments, which differ in no more bits than the sets in members, spare most pairs that.

* Of each set, as many of its most frequent segments are left out as may be.
* Equal sets are one node from the start, so copies never meet each other.
* Sets are first compared with one drawn leader per segment, in a few turns. What that links
  is one component, within which no further pair is looked at; after that all pairs of
  different components are compared that share as many segments as they must. A group of
  thousands of near copies thus costs about its size, not its square, and no link is lost.
* Where more than CROWD sets are left on a segment, as forms that were filled in differently, they
  are compared only if they share a member that is rare in both. Their number does not
  change what is found, only how.

NULL and empty texts have no n-grams and are linked with nothing; they are components of
their own. Rows may repeat, with the same id or others. Nodes are told apart by a 64-bit hash
of their sets (two of a million different sets share one with a probability below 1e-7).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from cilode.llm.common import attached, per_worker, slices, stored
from cilode.llm.components import components
from cilode.llm.hashing import mix, set_hash, shingles

WIDTH = 4
PERCENT = 85
# Fragments in which overlaps are counted.
COUNTED = 8
# Turns in which nodes are compared with leaders only.
ROUNDS = 2
# Sets of different components on one segment are compared with each other if they are no more than this.
CROWD = 200
# The number of segments that may be left out is kept in so many bits; fewer are right too.
_FIELD = 13

ROWS = "key long, node long, info int, doc_id long, n_shingles long"


def most_different(size: int, percent: int = PERCENT) -> int:
    """In how many members two alike sets may differ if neither is larger than `size`."""
    return 2 * size * (100 - percent) // (100 + percent)


def _spare(level: int) -> int:
    """Fragments of a level beyond those that may all differ."""
    return max(2, (1 << level) // 8)


def _level(size: int, percent: int) -> int:
    level = 2
    while (1 << level) - _spare(level) < most_different(size, percent) + 1:
        level += 1
    return level


def _largest(level: int, percent: int) -> int:
    """The largest set of a level."""
    most = (1 << level) - _spare(level) - 1
    return ((most + 1) * (100 + percent) - 1) // (2 * (100 - percent))


def _levels(size: int, percent: int) -> list[tuple[int, int]]:
    """The levels at which a set of that size may have partners, its own first, and in how many
    members it may differ from any partner there."""
    partner = size * 100 // percent
    return [
        (level, most_different(min(partner, _largest(level, percent)), percent))
        for level in range(_level(size, percent), _level(partner, percent) + 1)
    ]


def segment_rows(members: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set's segments, and for each its level, the number of the set's segments there
    that may be left out, and whether the level is not the set's own."""
    size, sums = len(members), set_hash(members)
    keys, infos = [], []
    if most_different(size * 100 // percent, percent) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    for turn, (level, most) in enumerate(_levels(size, percent)):
        count = 1 << level
        cuts = np.arange(1, count, dtype=np.uint64) << np.uint64(64 - level)
        at = np.concatenate(([0], np.searchsorted(members, cuts), [size]))
        held = np.flatnonzero(at[1:] > at[:-1])
        # A pair has at least count - most equal segments, of which so many may be empty.
        surplus = count - 1 - most - (count - len(held))
        if surplus < 0:
            held = np.arange(count)
        inside = sums[at[held + 1]] - sums[at[held]]
        keys.append(mix(inside ^ mix((held + (level << 40)).astype(np.uint64))).view(np.int64))
        spare = min(max(surplus, 0), (1 << _FIELD) - 1)
        infos.append(np.full(len(held), (level << _FIELD | spare) << 1 | (turn > 0), np.int32))
    return np.concatenate(keys), np.concatenate(infos)


def parity(members: np.ndarray) -> int:
    """64 bits, each the parity of the members that fall on it. Two sets differ in at least as
    many members as their parities in bits."""
    bits = np.uint64(1) << (mix(members ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(63))
    return int(np.bitwise_xor.reduce(bits, initial=np.uint64(0)).view(np.int64))


def _node(members: np.ndarray) -> int:
    return int(mix(set_hash(members)[-1:] + np.uint64(len(members))).view(np.int64)[0])


def _text_bytes(column) -> list[bytes]:
    """Texts as bytes, A-Z in lower case; NULL is empty."""
    return [(t or b"").lower() for t in column.cast(pa.binary()).to_pylist()]


def _segments(width: int, percent: int):
    """One row per text (info is NULL), and one per segment of a set new to the task."""

    def run(batches):
        per_worker(("none",), dict)  # a worker's memory is not for what other operators kept
        seen = set()
        for batch in slices(batches):
            ids = batch.column(0).to_pylist()
            keys, nodes, infos = [], [], []
            heads = []
            for row, data in enumerate(_text_bytes(batch.column(1))):
                members = shingles(data, width)
                node = _node(members) if len(members) else None
                heads.append((hash((ids[row], row)), node, ids[row], len(members)))
                if node is None or node in seen:
                    continue
                seen.add(node)
                key, info = segment_rows(members, percent)
                keys.append(key)
                infos.append(info)
                nodes.append(np.full(len(key), node, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([h[0] for h in heads], pa.int64()),
                    pa.array([h[1] for h in heads], pa.int64()),
                    pa.nulls(len(heads), pa.int32()),
                    pa.array([h[2] for h in heads], pa.int64()),
                    pa.array([h[3] for h in heads], pa.int64()),
                ],
                names=["key", "node", "info", "doc_id", "n_shingles"],
            )
            if keys:
                key = np.concatenate(keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key),
                        pa.array(np.concatenate(nodes)),
                        pa.array(np.concatenate(infos)),
                        pa.nulls(len(key), pa.int64()),
                        pa.nulls(len(key), pa.int64()),
                    ],
                    names=["key", "node", "info", "doc_id", "n_shingles"],
                )

    return run


def _fragments(width: int, percent: int):
    """(node, size, fragment, members, parity of the members) of each text."""

    def run(batches):
        for batch in slices(batches):
            rows = []
            for data in _text_bytes(batch.column(0)):
                members = shingles(data, width)
                if not len(members):
                    continue
                node = _node(members)
                where = (members >> np.uint64(64 - COUNTED.bit_length() + 1)).astype(np.int64)
                at = np.searchsorted(where, np.arange(COUNTED + 1))
                rows += [
                    (node, len(members), f, members[at[f] : at[f + 1]].tobytes(), parity(members[at[f] : at[f + 1]]))
                    for f in range(COUNTED)
                    if at[f + 1] > at[f]
                ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int32()),
                    pa.array([r[3] for r in rows], pa.binary()),
                    pa.array([r[4] for r in rows], pa.int64()),
                ],
                names=["node", "size", "fragment", "members", "parity"],
            )

    return run


@F.arrow_udf(LongType())
def _overlap(left: pa.Array, right: pa.Array) -> pa.Array:
    """Number of members that two segments share."""
    return pa.array(
        [
            len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
            for a, b in zip(left.to_pylist(), right.to_pylist())
        ],
        pa.int64(),
    )


def _linked(pairs: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold: overlaps per fragment, summed."""
    left = fragments.select(F.col("node").alias("a"), F.col("size").alias("size_a"), "fragment", F.col("members").alias("left"))
    right = fragments.select(F.col("node").alias("b"), F.col("size").alias("size_b"), "fragment", F.col("members").alias("right"))
    partial = (
        pairs.join(left, "a")
        .join(right, ["b", "fragment"])
        .select("a", "b", "size_a", "size_b", _overlap("left", "right").alias("shared"))
    )
    summed = partial.groupBy("a", "b", "size_a", "size_b").agg(F.sum("shared").alias("shared"))
    return summed.where(F.col("shared") * (100 + percent) >= percent * (F.col("size_a") + F.col("size_b"))).select("a", "b")


def _sketches(fragments: DataFrame) -> DataFrame:
    """node, size, and the parity of each fragment."""
    return fragments.groupBy("node").agg(
        F.first("size").alias("size"),
        *[
            F.coalesce(F.max(F.when(F.col("fragment") == f, F.col("parity"))), F.lit(0)).alias(f"parity{f}")
            for f in range(COUNTED)
        ],
    )


def _may_link(percent: int, other: str) -> Column:
    """Whether parities leave it open that two sets are alike; `other` ends the second's names."""
    bits = sum(
        (F.bit_count(F.col(f"parity{f}").bitwiseXOR(F.col(f"parity{f}{other}"))) for f in range(COUNTED)),
        start=F.lit(0),
    )
    return bits * (100 + percent) <= (F.col("size") + F.col(f"size{other}")) * (100 - percent)


def _met(placed: DataFrame, other: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a > b) of sets on the same segment, of different components, and perhaps alike."""
    ends = other.select("key", *[F.col(c).alias(f"{c}_b") for c in other.columns if c != "key"])
    pairs = placed.join(ends, "key").where((F.col("part") != F.col("part_b")) & _may_link(percent, "_b"))
    return pairs.select(F.greatest("node", "node_b").alias("a"), F.least("node", "node_b").alias("b")).distinct()


def _led(placed: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of every node with one leader of each of its segments. Leaders are drawn per segment
    and turn: a node meets as many others as it has segments, and a group is soon one
    component even if few of its pairs are links."""
    row = F.struct(F.xxhash64("key", "node", F.lit(turn)).alias("lot"), *placed.columns)
    leaders = placed.groupBy("key").agg(F.min(row).alias("first")).select("first.*").drop("lot")
    return _met(placed, leaders, percent)


def _crossing(placed: DataFrame, fragments: DataFrame, percent: int, crowd: int) -> DataFrame:
    """All pairs of different components that may be alike: those on the same segment of the larger one's
    level, and of sets on a segment that more than `crowd` share, those that share a rare member."""
    crowded = stored(placed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key"), "crowded")
    if crowded.isEmpty():
        return _met(placed, placed.where("own"), percent)
    others = placed.join(crowded, "key", "left_anti")
    sets = placed.join(crowded, "key", "left_semi").drop("key", "own").dropDuplicates(["node"])
    rare = _rare_pairs(stored(sets, "crowd"), fragments, percent)
    return _met(others, others.where("own"), percent).unionByName(rare).distinct()


def _members(batches):
    """One row per member of a fragment."""
    for batch in batches:
        held = [np.frombuffer(m, np.int64) for m in batch.column(1).to_pylist()]
        rows = pa.array(np.repeat(np.arange(len(held)), [len(m) for m in held]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(np.concatenate(held))], names=["node", "member"])


def _sharing_rare(sets: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets that share a member which is rare in both.

    Sets on a crowded segment share a form, and differ in what is rare. In the order of how many of
    these sets hold a member, two alike sets share one among the first few of the smaller set
    and the first of the larger: else more would be missing than may. So sets whose own
    parts are too many to be alike do not meet at all, however many share the form.
    """
    members = fragments.join(sets.select("node"), "node", "left_semi").select("node", "members").mapInArrow(_members, "node long, member long")
    members = stored(members, "members")
    counts = stored(members.groupBy("member").agg(F.count("*").alias("__n")), "member-counts")
    ranked = attached(members, counts.withColumn("held", F.col("__n")), "member").join(sets.select("node", "size"), "node")
    order = Window.partitionBy("node").orderBy("held", "member")
    ranked = ranked.withColumn("rank", F.row_number().over(order))
    # The fewest members shared with a larger set, and with a smaller one.
    with_larger = F.expr(f"({2 * percent} * size + {99 + percent}) div {100 + percent}")
    with_smaller = F.expr(f"({percent} * size + 99) div 100")
    kept = stored(
        ranked.where(F.col("rank") <= F.col("size") - with_smaller + 1).select(
            "node", "size", "member", (F.col("rank") <= F.col("size") - with_larger + 1).alias("first")
        ),
        "rare",
    )
    smaller = kept.where("first").select(F.col("node").alias("a"), F.col("size").alias("size_a"), "member")
    larger = kept.select(F.col("node").alias("b"), F.col("size").alias("size_b"), "member")
    in_order = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("a") < F.col("b")))
    return smaller.join(larger, "member").where(in_order).select("a", "b").distinct()


def _rare_pairs(sets: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a rare member, and are perhaps alike."""
    pairs = _sharing_rare(sets, fragments, percent)
    ends = sets.select(*[F.col(c).alias(f"{c}_b") for c in sets.columns])
    met = pairs.join(sets, pairs["a"] == sets["node"]).join(ends, F.col("b") == F.col("node_b"))
    met = met.where((F.col("part") != F.col("part_b")) & _may_link(percent, "_b"))
    return met.select(F.greatest("node", "node_b").alias("a"), F.least("node", "node_b").alias("b"))


def _telling(shared: DataFrame) -> DataFrame:
    """The segments without each set's most frequent ones, as many as may be left out.

    If alike sets must share r segments, the rarest one they share is not among the r - 1 most
    frequent of either; the rest finds all pairs, and no longer by passages that many
    otherwise different texts have in common.
    """
    counts = shared.groupBy("key").agg(F.count("*").alias("texts"))
    level = F.shiftright("info", _FIELD + 1)
    spare = F.shiftright("info", 1).bitwiseAND((1 << _FIELD) - 1)
    frequent = Window.partitionBy("node", level).orderBy(F.desc("texts"), "key")
    ranked = shared.join(counts, "key").withColumn("rank", F.row_number().over(frequent))
    return ranked.where(F.col("rank") > spare).select("key", "node", (F.col("info").bitwiseAND(1) == 0).alias("own"))


def classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of `docs` (doc_id, text).

    component_id is the smallest id that is reachable by links. Rows with a NULL id take part in links,
    and are of the component they link; where no row of it has an id, it is NULL.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows = docs.mapInArrow(_segments(width, percent), ROWS).repartition("key")
    same = Window.partitionBy("key")
    kept = rows.select("*", (F.min("node").over(same) < F.max("node").over(same)).alias("met"))
    staged = stored(kept.where("info is null or met").drop("met"), "segments")
    labels = staged.where("info is null").select("doc_id", "n_shingles", "node")
    shared = stored(_telling(staged.where("info is not null").select("key", "node", "info").distinct()), "telling")

    # One text per node that shares a segment.
    nodes = shared.select("node").distinct()
    # Copies are counted down to one row per task before anything is dealt out by node.
    first = labels.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(nodes, "node")
    # Rows without an id are looked through as they are.
    texts = docs.join(first.select("doc_id").distinct(), "doc_id").unionByName(docs.where("doc_id is null"))
    fragments = stored(
        texts.select("text")
        .mapInArrow(_fragments(width, percent), "node long, size long, fragment int, members binary, parity long")
        .join(nodes, "node", "left_semi")
        .dropDuplicates(["node", "fragment"]),
        "fragments",
    )

    placed = stored(shared.join(_sketches(fragments), "node").withColumn("part", F.col("node")), "placed")
    # Every component is a star of edges to its least node, which is all that is kept of its links.
    stars = None
    for turn in range(ROUNDS + 1):
        pairs = _led(placed, turn, percent) if turn < ROUNDS else _crossing(placed, fragments, percent, crowd)
        found = stored(_linked(pairs, fragments, percent), "links")
        if stars is None or not found.isEmpty():
            stars = components(found if stars is None else stars.unionByName(found))
        part = stars.select(F.col("a").alias("node"), F.col("b").alias("part"))
        if turn < ROUNDS:
            # A least node is a part of its own already.
            met = placed.drop("part").join(part, "node", "left").withColumn("part", F.coalesce("part", "node"))
            mixed = met.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
            placed = stored(met.join(mixed.select("key"), "key"), "placed")

    named = (
        labels.where("node is not null")
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"))
        .join(part, "node", "left")
        .select("node", "doc_id", F.coalesce("part", "node").alias("component"))
    )
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    node_class = named.join(smallest, "component").select("node", "component_id")
    return labels.join(node_class, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def representatives(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` with one document of each class left: that with the smallest id.

    Texts without words are classes of their own. Rows that share an id share its fate, and
    repeated rows of the id that stays all stay: ids name documents.
    """
    found = classes(docs, width, percent)
    # NULL ids name no document; such rows are kept.
    dropped = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti")
