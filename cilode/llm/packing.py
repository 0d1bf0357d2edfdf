"""Packing documents into sequences along a Hilbert curve.

Each document's token ids become a hashed vector, projected to a few dimensions. The
documents are sorted by range along the Hilbert curve through that space, so that alike ones
are neighbours, and laid end to end in that order: sequence number and place of a token
follow from the number of tokens before it. Documents are cut where a sequence is full; only
the last sequence is not.

Ids are computed once and stored. Only lengths are sorted; the number of tokens before a
document is summed within range partitions and over their totals, of which there are as many
as partitions. Equal places on the curve are told apart by the document's id, so copies
spread over partitions.

NULL and empty texts have the end id only. Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cilode.llm.common import slices, stored
from cilode.llm.word_ids import word_ids

LENGTH = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
DIMENSIONS = 3
BITS = 16
_SEED = 11
# Ids that have a direction of their own.
TABLE = 1 << 16

TOKENS = "doc_id long, curve long, n_tokens long, ids binary"


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file on this machine; full paths stay as they are."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def directions(size: int) -> np.ndarray:
    """A pseudo-random direction for each id, computed from the id, longer for rarer tokens:
    a vocabulary that is made by merges lists frequent ones first."""
    seeds = np.arange(size * DIMENSIONS, dtype=np.uint64).reshape(size, DIMENSIONS) + np.uint64(_SEED)
    seeds = (seeds + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    seeds = (seeds ^ (seeds >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    seeds = (seeds ^ (seeds >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    between = (seeds >> np.uint64(40)).astype(np.float32) / (1 << 23) - 1.0
    return between * (np.log1p(np.arange(size, dtype=np.float32)) / np.log1p(size))[:, None]


def projection(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A document's hashed vector in DIMENSIONS dimensions, each between 0 and 1.

    The directions of its tokens are added, scaled as independent ones would spread, and
    squeezed into the interval. Ids beyond the table take the place of another.
    """
    if int(ids.max()) >= len(table):
        ids = ids % len(table)
    point = np.ones(len(ids), np.float32) @ table[ids] / np.sqrt(len(ids) / 3)
    return 0.5 + np.arctan(point) / np.pi


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of integer points (rows, dimensions) of `bits` bits.

    Per bit from the top, the lower bits of the axes are reflected or exchanged; the Gray
    code of what is left, its bits interleaved, is the place.
    """
    x = cells.astype(np.int64).T.copy()
    dimensions = len(x)
    for level in range(bits - 1, 0, -1):
        bit, lower = 1 << level, (1 << level) - 1
        for axis in range(dimensions):
            reflect = (x[axis] & bit) != 0
            swap = np.where(reflect, 0, (x[0] ^ x[axis]) & lower)
            x[0] ^= np.where(reflect, lower, swap)
            x[axis] ^= swap
    for axis in range(1, dimensions):
        x[axis] ^= x[axis - 1]
    turned = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turned ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turned
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(dimensions):
            key = (key << 1) | ((x[axis] >> level) & 1)
    return key


def _tokens(vocabulary: str):
    """doc_id, place on the curve, number of tokens, and the ids in 16 or 32 bits."""

    def run(batches):
        encoder, table = word_ids(vocabulary_path(vocabulary)), directions(TABLE)
        for batch in slices(batches):
            points, counts, held = [], [], []
            for text in batch.column(1).to_pylist():
                ids = np.append(encoder.ids(text or ""), np.uint32(END_ID))
                points.append(projection(ids, table))
                counts.append(len(ids))
                held.append(pack(ids))
            cells = np.array(points).reshape(-1, DIMENSIONS) * ((1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(hilbert(cells), pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(held, pa.binary()),
                ],
                names=["doc_id", "curve", "n_tokens", "ids"],
            )

    return run


def pack(ids: np.ndarray) -> bytes:
    """Ids in 16 bits each if all fit, else in 32, told by the first byte."""
    if len(ids) and int(ids.max()) >> 16:
        return b"\x04" + ids.astype("<u4").tobytes()
    return b"\x02" + ids.astype("<u2").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4" if data[0] == 4 else "<u2", offset=1).astype("<u4")


def _pieces(length: int):
    """Cut each document where a sequence is full."""

    def run(batches):
        for batch in slices(batches):
            out = {name: [] for name in ("row", "start", "length", "crc", "sequence", "offset")}
            for row, (before, data) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                ids = unpack(data)
                start = 0
                while start < len(ids):
                    sequence, offset = divmod(before + start, length)
                    end = min(len(ids), start + length - offset)
                    for name, value in zip(
                        out, (row, start, end - start, zlib.crc32(ids[start:end].tobytes()), sequence, offset)
                    ):
                        out[name].append(value)
                    start = end
            rows = pa.array(out["row"], pa.int64())
            columns = {name: pa.array(out[name], pa.int64()) for name in out}
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    columns["start"],
                    columns["length"],
                    columns["crc"],
                    batch.column(3).take(rows),
                    columns["sequence"],
                    columns["offset"],
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def tokens_before(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """The rows with the sum of `size` over all rows before them in the total order `order`."""
    ranged = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranged = stored(ranged, "ranged")
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__part").agg(F.sum(size).alias("__total"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__before"))
    return (
        ranged.withColumn("before", F.coalesce(F.sum(size).over(within), F.lit(0)))
        .join(F.broadcast(offsets), "__part")  # one row per partition
        .withColumn("before", F.col("before") + F.col("__before"))
        .drop("__part", "__before")
    )


def packed(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece."""
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    tokens = texts.mapInArrow(_tokens(vocabulary), TOKENS)
    # Written once, the number of a row stays.
    tokens = stored(tokens.withColumn("row", F.monotonically_increasing_id()), "tokens")
    placed = tokens_before(tokens.select("curve", "doc_id", "row", "n_tokens"), ["curve", "doc_id", "row"], "n_tokens")
    rows = tokens.drop("curve", "doc_id").join(placed.select("row", "doc_id", "before"), "row")
    return rows.select("doc_id", "before", "ids", "n_tokens").mapInArrow(
        _pieces(length),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
