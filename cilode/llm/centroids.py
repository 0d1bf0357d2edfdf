"""Clusters around centroids, with distances summed over dictionaries of subvectors.

Components become whole numbers, so that every distance, sum and mean is exact and no order
of adding matters. A task cuts its vectors into chunks and each vector into blocks of a few
dimensions; within a chunk, the distinct subvectors of a block are its dictionary, and a
vector is one code per block. Nothing is lost: the codes give back the vector. In a round, the
squared distances of a chunk's distinct subvectors to all centroids are computed once, and a
vector's distance is the sum of what its codes point to. Copies of a vector, or of a part of
it, cost one distance and share a code.

Dictionaries belong to chunks because one for the whole table would have to be joined with
the codes of all vectors in each round. So no round moves a vector: a chunk gives, per
cluster, the number and the sum of its vectors; only these are shuffled, and as many rows as
there are centroids reach the driver. Chunks are written once; a lost executor costs the
chunks it was at.

Vectors count if they have the wanted number of components, none of them NULL or not finite;
others are left out. Centroids start as the vectors whose ids have the smallest hashes, ties
among repeated ids in the order of the vectors; with fewer vectors there are fewer centroids,
and an empty table gives no rows. Equal distances go to the smaller number; repeated rows are
vectors of their own. A NULL id hashes as one without digits. A component beyond LARGEST after
scaling, where squared distances leave 64 bits, is an error. Only the id and the vector are
read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cilode.llm.common import slices, stored

DIMENSIONS = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
SEED = 3
# Dimensions of a block, and vectors of a chunk: they bound memory and choose what is shared.
WIDTH = 2
CHUNK_ROWS = 1 << 14
LARGEST = 1 << 27

CHUNKS = "vec_ids array<long>, codes binary, sizes array<int>, subvectors binary"


def whole(vector: Column, scale: int = SCALE) -> Column:
    """The components as whole numbers."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column, dimensions: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


def vectors(table: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and whole-numbered vector of the rows that count."""
    return table.where(usable(F.col("embedding"), dimensions)).select(
        F.col("vec_id").cast("long"), whole(F.col("embedding"), scale).alias("vector")
    )


def encode(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a block and the number of each row among them."""
    keys = np.ascontiguousarray(block).view([("", block.dtype)] * block.shape[1]).ravel()
    _, first, codes = np.unique(keys, return_index=True, return_inverse=True)
    return block[first], codes.ravel()


def _chunk(ids: list, values: np.ndarray, width: int) -> pa.RecordBatch:
    codes, sizes, held = [], [], []
    for at in range(0, values.shape[1], width):
        distinct, code = encode(values[:, at : at + width])
        codes.append(code.astype("<u4").tobytes())
        sizes.append(len(distinct))
        held.append(distinct.astype("<i4").tobytes())
    columns = [
        pa.array([ids], pa.list_(pa.int64())),
        pa.array([b"".join(codes)], pa.binary()),
        pa.array([sizes], pa.list_(pa.int32())),
        pa.array([b"".join(held)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["vec_ids", "codes", "sizes", "subvectors"])


def _encoded(dimensions: int, width: int, rows: int):
    def run(batches):
        ids, parts = [], []
        for batch in slices(batches, rows):
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            if len(values) and max(int(values.max()), -int(values.min())) > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST} after scaling: squared distances leave 64 bits")
            if ids and len(ids) + len(values) > rows:
                yield _chunk(ids, np.concatenate(parts), width)
                ids, parts = [], []
            ids += batch.column(0).to_pylist()
            parts.append(values)
        if ids:
            yield _chunk(ids, np.concatenate(parts), width)

    return run


def encoded(kept: DataFrame, dimensions: int = DIMENSIONS, width: int = WIDTH, rows: int = CHUNK_ROWS) -> DataFrame:
    """The vectors as chunks of codes with their dictionaries, stored."""
    return stored(kept.mapInArrow(_encoded(dimensions, width, rows), CHUNKS), "chunks")


def _blocks(row: dict, dimensions: int, width: int):
    """Per block of a chunk: its dimensions, distinct subvectors, and a code per vector."""
    n = len(row["vec_ids"])
    codes = np.frombuffer(row["codes"], "<u4").reshape(-1, n)
    held, at = np.frombuffer(row["subvectors"], "<i4"), 0
    for number, size in enumerate(row["sizes"]):
        span = slice(number * width, min(dimensions, (number + 1) * width))
        wide = span.stop - span.start
        yield span, held[at : at + size * wide].reshape(size, wide).astype(np.int64), codes[number]
        at += size * wide


def _nearest(row: dict, centroids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each vector of a chunk."""
    sums = np.zeros((len(row["vec_ids"]), len(centroids)), np.int64)
    for span, distinct, codes in _blocks(row, centroids.shape[1], width):
        partial = np.zeros((len(distinct), len(centroids)), np.int64)
        for i, d in enumerate(range(span.start, span.stop)):
            partial += (distinct[:, i, None] - centroids[None, :, d]) ** 2
        sums += partial[codes]
    nearest = sums.argmin(axis=1)
    return nearest, sums[np.arange(len(sums)), nearest]


def _totals(centroids: np.ndarray, width: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                nearest, _ = _nearest(row, centroids, width)
                sums = np.zeros(centroids.shape, np.int64)
                for span, distinct, codes in _blocks(row, centroids.shape[1], width):
                    np.add.at(sums[:, span], nearest, distinct[codes])
                counts = np.bincount(nearest, minlength=len(centroids))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(len(centroids)), pa.int32()),
                        pa.array(counts, pa.int64()),
                        pa.array(sums.tolist(), pa.list_(pa.int64())),
                    ],
                    names=["cluster", "n", "sums"],
                )

    return run


def start(kept: DataFrame, count: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest hashes of their ids."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select(digest.alias("digest"), "vector").orderBy("digest", "vector").limit(count)
    return np.array([r.vector for r in sorted(first.collect(), key=lambda r: (r.digest, r.vector))], np.int64)


def step(chunks: DataFrame, centroids: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The centroids after one round: floors of the means of their vectors, empty ones as they were."""
    k, dimensions = centroids.shape
    rows = (
        chunks.mapInArrow(_totals(centroids, width), "cluster int, n long, sums array<long>")
        .groupBy("cluster")
        .agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dimensions)]).alias("sums"))
        .collect()  # one row per centroid
    )
    moved = centroids.copy()
    for row in rows:
        if row.n:
            moved[row.cluster] = [total // row.n for total in row.sums]
    return moved


def fitted(chunks: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS, width: int = WIDTH) -> np.ndarray:
    for _ in range(rounds if len(centroids) else 0):
        centroids = step(chunks, centroids, width)
    return centroids


def _assigned(centroids: np.ndarray, width: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                nearest, distance = _nearest(row, centroids, width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["vec_ids"], pa.int64()), pa.array(nearest, pa.int32()), pa.array(distance, pa.int64())],
                    names=["vec_id", "cluster", "distance"],
                )

    return run


def assigned(chunks: DataFrame, centroids: np.ndarray, width: int = WIDTH) -> DataFrame:
    """vec_id, cluster, distance (squared) of every vector."""
    return chunks.mapInArrow(_assigned(centroids, width), "vec_id long, cluster int, distance long")


def digests(centroids: np.ndarray) -> list[tuple[int, str]]:
    """The number of each centroid with the hash of its components."""
    return [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]


def report(
    table: DataFrame,
    count: int = CENTROIDS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    width: int = WIDTH,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per vector that counts."""
    kept = vectors(table, dimensions, scale)
    chunks = encoded(kept, dimensions, width, rows)
    centroids = fitted(chunks, start(kept, count), rounds, width)
    placed = stored(assigned(chunks, centroids, width), "assigned")
    totals = {
        row.cluster: row.total for row in placed.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()
    }
    # One row per centroid.
    facts = placed.sparkSession.createDataFrame(
        [(i, totals.get(i), sum(totals.values()), digest) for i, digest in digests(centroids)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return placed.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
