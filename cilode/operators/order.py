"""Places of rows in a total order, without a sort in one task.

Rows go to partitions by ranges of the order, so a partition knows its rows' places once it
knows how many come before it. Those totals, one per partition, are all that reaches the
driver. Rows are moved once; NULLs come first, as in Spark's own order.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cilode.operators.stored import stored

_PART = "__part"
# Rows of a partition are counted in the low bits of Spark's increasing ids.
_ROW_BITS = 33


def _with_offsets(rows: DataFrame, totals: list[str]) -> DataFrame:
    """Join each partition's sums over the partitions before it, as `__before_<name>`."""
    sums = rows.groupBy(_PART).agg(*[F.sum(name).alias(name) for name in totals])
    held = sorted(sums.collect(), key=lambda r: r[_PART])  # one row per partition
    before = [list(accumulate((r[name] for r in held), initial=0)) for name in totals]
    offsets = rows.sparkSession.createDataFrame(
        [(r[_PART], *[b[i] for b in before]) for i, r in enumerate(held)],
        f"{_PART} long, " + ", ".join(f"__before_{name} long" for name in totals),
    )
    return rows.join(F.broadcast(offsets), _PART)


def numbered(rows: DataFrame, order: list[str], into: str = "number") -> DataFrame:
    """The rows with their places 0, 1, ... in the order of the columns `order`.

    Rows that are equal in all of them have places next to each other, in any order.
    """
    kept = rows.columns
    ids = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = stored(
        ids.select(
            *[F.col(f"`{c}`") for c in kept],
            F.shiftright("__id", _ROW_BITS).alias(_PART),
            F.col("__id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("__row"),
            F.lit(1).cast("long").alias("__one"),
        ),
        "numbered",
    )
    number = F.col("__before___one") + F.col("__row")
    return _with_offsets(placed, ["__one"]).select(*[F.col(f"`{c}`") for c in kept], number.alias(into))


def with_sums_before(rows: DataFrame, order: list[str], sizes: dict[str, Column]) -> DataFrame:
    """The rows with the sum of each size over all rows before them, under the size's name.

    The order should tell rows apart; rows that are equal in it come in any one order.
    """
    kept = rows.columns
    sized = rows.select(*[F.col(f"`{c}`") for c in kept], *[size.cast("long").alias(f"__{name}") for name, size in sizes.items()])
    ranged = sized.repartitionByRange(*order).withColumn(_PART, F.spark_partition_id().cast("long"))
    ranged = stored(ranged, "ranged")
    within = Window.partitionBy(_PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # All sums look at the same sorted rows.
    summed = reduce(
        lambda df, name: df.withColumn(f"__within_{name}", F.coalesce(F.sum(f"__{name}").over(within), F.lit(0))), sizes, ranged
    )
    joined = _with_offsets(summed, [f"__{name}" for name in sizes])
    return joined.select(
        *[F.col(f"`{c}`") for c in kept],
        *[(F.col(f"__before___{name}") + F.col(f"__within_{name}")).alias(name) for name in sizes],
    )
