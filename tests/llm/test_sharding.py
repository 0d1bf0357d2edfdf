"""Shards of a k-d tree: balance, whole groups, gapless slots."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from cilode.llm import sharding as H

SCHEMA = "doc_id long, text string, size int, shard string"


def run(spark, texts, shards=8):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)]
    got = H.sharded(spark.createDataFrame(rows, SCHEMA), shards).collect()
    held, sizes, slots = {}, Counter(), defaultdict(list)
    assert len(got) == len(rows)
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        assert held.setdefault(data, r.shard) == r.shard
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sizes) <= set(range(shards))
    return sizes


def test_sizes_are_near_equal(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\n") for _ in range(int(rng.paretovariate(1) * 20) % 2000)) for _ in range(3000)]
    sizes = run(spark, texts)
    most = max(len(t.encode()) + 1 for t in texts)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 4 * most


def test_ties_are_cut_by_hash(spark):
    sizes = run(spark, [f"{i:05d}" for i in range(4000)])
    assert max(sizes.values()) <= 1.02 * min(sizes.values())


def test_copies_stay_together(spark):
    sizes = run(spark, ["copy of a third"] * 700 + [f"text {i} {'x' * (i % 50)}" for i in range(1400)])
    assert max(sizes.values()) >= 700 * 16


def test_odd_tables(spark):
    assert run(spark, []) == {}
    assert sum(run(spark, [None, "", None, "a"]).values()) == 5
    run(spark, ["one"])
    run(spark, ["a", "b", "c"], shards=3)
    assert H.sharded(spark.createDataFrame([(None, None, 1, "x")] * 3, SCHEMA)).count() == 3


def coordinates(text):
    """Bytes, characters and lines of a text, each told apart by the upper half of its hash."""
    data = (text or "").encode()
    tie = xxhash.xxh64_intdigest(data, seed=42) >> 32
    return [(n << 32) | tie for n in (len(data), len(text or ""), (text or "").count("\n"))]


def plain_tree(points, shards, extent, first=0):
    """Shard of each (coordinates, weight): split at the weighted median along the widest axis."""
    if shards == 1 or not points:
        return {at: first for at, _ in points}
    spans = [max(p[0][a] for p in points) - min(p[0][a] for p in points) for a in range(3)]
    axis = max(range(3), key=lambda a: spans[a] / max(extent[a], 1))
    target, done = sum(w for _, w in points) * (shards // 2) // shards, 0
    weights = Counter()
    for at, weight in points:
        weights[at[axis]] += weight
    for value, weight in sorted(weights.items()):
        if done + weight > target:
            break
        done += weight
    cut = value if target - done > done + weight - target else value - 1
    left, right = [p for p in points if p[0][axis] <= cut], [p for p in points if p[0][axis] > cut]
    half = shards // 2
    return {**plain_tree(left, half, extent, first), **plain_tree(right, shards - half, extent, first + half)}


@pytest.mark.parametrize("shards", [2, 8, 13])
def test_against_a_plain_tree(spark, shards):
    rng = random.Random(shards)
    texts = ["".join(rng.choice("ab é\n") for _ in range(int(rng.paretovariate(1) * 9) % 900)) for _ in range(700)]
    texts += ["copy\n" * 7] * 200 + [None, "", "x" * 30_000]
    points = [(tuple(coordinates(t)), len((t or "").encode()) + 1) for t in texts]
    extent = [max(p[0][a] for p in points) - min(p[0][a] for p in points) for a in range(3)]
    want = plain_tree(points, shards, extent)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: r.shard for r in H.sharded(docs, shards).collect()}
    assert got == {i: want[tuple(coordinates(t))] for i, t in enumerate(texts)}


def test_leaves_reach_the_target(spark):
    rng = random.Random(2)
    texts = [f"{i:05d}" + "w" * rng.randrange(300) for i in range(2000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], SCHEMA)
    sizes = Counter()
    for r in H.sharded_to(docs, 20_000).collect():
        sizes[r.shard] += r["size"]
    assert len(sizes) == -(-sum(sizes.values()) // 20_000) and max(sizes.values()) < 20_000 + 4 * 306
    assert H.sharded_to(docs.where("false"), 100).collect() == []


def test_a_very_long_text(spark):
    texts = ["é\n" * 2_000_000, "short", "other"] + [f"t{i}" for i in range(50)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in H.sharded(docs).collect()}
    assert got[0]["size"] == 6_000_001 and len([r for r in got.values() if r.shard == got[0].shard]) >= 1 and len(got) == 53
