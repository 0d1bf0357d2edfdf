"""Balanced shards by a k-d tree over the metadata of documents.

Coordinates are numbers that follow from the text: its bytes, its code points and its lines.
A node is split at the weighted median of its widest dimension, in bytes, until a leaf
has the target size; all nodes of a depth are split together. A median is found by
histograms: one aggregate counts the weight of BINS intervals of every open node, the
interval that holds the median is cut again. Nothing but histograms reaches the driver.

Equal values of a coordinate are told apart by a hash of the text, so a node can be cut
anywhere but inside a group of equal texts, which stays whole. The tree has a handful of
nodes and is applied to the rows as one CASE expression: no row moves to find its shard.

NULL counts as an empty text. Repeated rows are equal texts and share a shard. A text of any length
is three numbers and a checksum; one that is larger than a shard is a leaf of its own. An
empty table gives no rows. Rows with a NULL id are placed like others. Only the id and the text are
read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cilode.llm.common import stored

SHARDS = 8
BINS = 4096
# Numbers of rows in one run of slots; a run is what one task numbers.
RUN_ROWS = 100_000
_HASH_BITS = 32


def text_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def coordinates(text: Column) -> dict[str, Column]:
    """Metadata of a text as whole numbers, each followed by 32 bits of the text's hash."""
    held = F.coalesce(text, F.lit(""))
    tie = F.shiftrightunsigned(F.xxhash64(held), 64 - _HASH_BITS)
    values = {
        "bytes": F.octet_length(held),
        "chars": F.length(held),
        "lines": F.length(held) - F.length(F.replace(held, F.lit("\n"), F.lit(""))),
    }
    return {name: F.shiftleft(value.cast("long"), _HASH_BITS).bitwiseOR(tie) for name, value in values.items()}


@dataclass
class Node:
    """A box of the tree. `low` and `high` are the least and largest coordinates in it."""

    weight: int
    low: dict[str, int]
    high: dict[str, int]
    shards: int
    first: int
    axis: str | None = None
    cut: int | None = None  # coordinates up to the cut go left
    below: list[Node] = field(default_factory=list)

    def leaf(self) -> bool:
        return self.axis is None


def _which(root: Node, names: dict[int, int]) -> Column:
    """Number of the open leaf that a row falls into, as an expression."""
    if root.leaf():
        return F.lit(names[id(root)])
    return F.when(F.col(root.axis) <= root.cut, _which(root.below[0], names)).otherwise(_which(root.below[1], names))


def _leaves(node: Node) -> list[Node]:
    return [node] if node.leaf() else [leaf for b in node.below for leaf in _leaves(b)]


def _boxes(points: DataFrame, root: Node | None, axes: list[str]) -> dict[int, tuple]:
    """Weight and extent of every leaf."""
    leaves = _leaves(root) if root else []
    number = _which(root, {id(leaf): i for i, leaf in enumerate(leaves)}) if root else F.lit(0)
    extent = [f(a).alias(f"{f.__name__}_{a}") for a in axes for f in (F.min, F.max)]
    rows = points.groupBy(number.alias("leaf")).agg(F.sum("weight").alias("weight"), *extent).collect()
    return {
        r["leaf"]: (r["weight"], {a: r[f"min_{a}"] for a in axes}, {a: r[f"max_{a}"] for a in axes}) for r in rows
    }


def _widest(node: Node, root: Node, axes: list[str]) -> str:
    """The axis whose extent is the largest part of its extent in all data."""
    return max(axes, key=lambda a: (node.high[a] - node.low[a]) / max(root.high[a] - root.low[a], 1))


def _cuts(points: DataFrame, root: Node, open_: list[Node], axes: list[str], bins: int) -> None:
    """Set `axis` cuts of the open leaves: the coordinate up to which the weight is nearest
    to the left shards' part of it."""
    chosen = {id(n): _widest(n, root, axes) for n in open_}
    spans = {id(n): (n.low[chosen[id(n)]], n.high[chosen[id(n)]], 0) for n in open_}
    cuts: dict[int, tuple[int, int]] = {}
    while len(cuts) < len(open_):
        todo = [n for n in open_ if id(n) not in cuts]
        leaves = _leaves(root)
        numbers = {id(leaf): i for i, leaf in enumerate(leaves)}
        cell = F.lit(None).cast("long")
        for n in todo:
            low, high, _ = spans[id(n)]
            step = max(1, -(-(high - low + 1) // bins))
            name = chosen[id(n)]
            inside = (F.col("leaf") == numbers[id(n)]) & F.col(name).between(low, high)
            cell = F.when(inside, F.expr(f"({name} - {low}L) div {step}L")).otherwise(cell)
        rows = (
            points.withColumn("leaf", _which(root, numbers))
            .withColumn("cell", cell)
            .where("cell is not null")
            .groupBy("leaf", "cell")
            .agg(F.sum("weight").alias("weight"))
            .collect()  # at most `bins` rows for each open node
        )
        for n in todo:
            low, high, before = spans[id(n)]
            step = max(1, -(-(high - low + 1) // bins))
            target = n.weight * (n.shards // 2) // n.shards
            done = before
            for cell_, weight in sorted((r["cell"], r["weight"]) for r in rows if r["leaf"] == numbers[id(n)]):
                if done + weight > target:
                    break
                done += weight
            if step == 1:
                value = low + cell_
                # Cut on the side of the group that is nearer to the target.
                after = target - done > done + weight - target
                cuts[id(n)] = (value if after else value - 1, done + weight if after else done)
            else:
                spans[id(n)] = (low + cell_ * step, min(high, low + (cell_ + 1) * step - 1), done)
    for n in open_:
        n.axis, (n.cut, _) = chosen[id(n)], cuts[id(n)]


def grow(points: DataFrame, axes: list[str], shards: int = SHARDS, bins: int = BINS) -> Node | None:
    """The tree over points (axes..., weight), with as many leaves as shards."""
    boxes = _boxes(points, None, axes)
    if not boxes:
        return None
    root = Node(*boxes[0], shards=shards, first=0)
    while open_ := [n for n in _leaves(root) if n.shards > 1 and n.weight]:
        _cuts(points, root, open_, axes, bins)
        for n in open_:
            half = n.shards // 2
            n.below = [
                Node(0, n.low, n.high, half, n.first),
                Node(0, n.low, n.high, n.shards - half, n.first + half),
            ]
        boxes = _boxes(points, root, axes)
        for i, leaf in enumerate(_leaves(root)):
            if i in boxes:
                leaf.weight, leaf.low, leaf.high = boxes[i]
    return root


def shard_of(root: Node | None) -> Column:
    """Shard of a row that has the coordinates as columns."""
    if root is None:
        return F.lit(None).cast("int")
    return _which(root, {id(leaf): leaf.first for leaf in _leaves(root)}).cast("int")


def numbered(rows: DataFrame, group: str, spread: Column, into: str, run_rows: int = RUN_ROWS) -> DataFrame:
    """Number the rows of each group from 0 without a gap, in runs that `spread` deals out."""
    rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()), "unnumbered")
    runs = max(64, rows.count() // run_rows)
    rows = rows.withColumn("__run", F.pmod(spread, F.lit(runs)))
    sizes = rows.groupBy(group, "__run").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(group).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col(group).alias("__group"),
        F.col("__run").alias("__of"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
    )
    within = F.row_number().over(Window.partitionBy(group, "__run").orderBy("__row"))
    joined = rows.withColumn("__at", within).join(
        sizes, (F.col(group) == F.col("__group")) & (F.col("__run") == F.col("__of"))
    )
    return joined.withColumn(into, (F.col("__before") + F.col("__at") - 1).cast("long")).drop(
        "__row", "__run", "__at", "__group", "__of", "__before"
    )


def sharded_to(docs: DataFrame, target_bytes: int) -> DataFrame:
    """`sharded` into as many shards as bring the leaves down to the target, as near as whole groups of
    equal texts allow."""
    total = docs.select((text_bytes(F.col("text")) + 1).alias("n")).agg(F.sum("n")).first()[0] or 0
    return sharded(docs, max(1, -(-total // target_bytes)))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per row of `docs`."""
    axes = coordinates(F.col("text"))
    points = stored(
        docs.select(
            "doc_id",
            (text_bytes(F.col("text")) + 1).alias("weight"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            *[axis.alias(name) for name, axis in axes.items()],
        ),
        "points",
    )
    tree = grow(points.select("weight", *axes), list(axes), shards)
    placed = points.select(
        "doc_id", F.col("weight").alias("size"), "text_crc32", shard_of(tree).alias("shard")
    )
    spread = F.xxhash64("doc_id", "text_crc32", "__row")
    return numbered(placed, "shard", spread, "slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
