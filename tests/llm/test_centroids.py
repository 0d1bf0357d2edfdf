"""Clusters against the same rounds in plain whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from cilode.llm import centroids as K

SCHEMA = "vec_id long, embedding array<float>, cluster string, vector int"


def brute(rows, dimensions, count, rounds):
    held = []
    for vec_id, vector in rows:
        if vector is not None and len(vector) == dimensions and all(x is not None and math.isfinite(x) for x in vector):
            exact = [math.floor(1024 * float(np.float32(x))) for x in vector]
            held.append((hashlib.sha256(f"3:{'' if vec_id is None else vec_id}".encode()).hexdigest(), exact, vec_id))
    held.sort(key=lambda h: h[:2])
    centres = [v for _, v, _ in held[:count]]

    def place(v):
        distances = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
        return distances.index(min(distances)), min(distances)

    for _ in range(rounds):
        groups = {}
        for _, v, _ in held:
            groups.setdefault(place(v)[0], []).append(v)
        for c, members in groups.items():
            centres[c] = [sum(axis) // len(members) for axis in zip(*members)]
    placed = [(i, *place(v)) for _, v, i in held]
    total = sum(d for _, _, d in placed)
    return [
        (i, c, d, sum(e for _, b, e in placed if b == c), total, hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest())
        for i, c, d in placed
    ]


def run(spark, held, dimensions=6, count=4, rounds=5, **parameters):
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in held], SCHEMA)
    got = [tuple(r) for r in K.report(table, count, rounds, dimensions, **parameters).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(held, dimensions, count, rounds)))
    return got


def points(n, dimensions=6, seed=8):
    rng = random.Random(seed)
    return [(i, [rng.gauss(rng.choice([-0.3, 0.1, 0.4]), 0.05) for _ in range(dimensions)]) for i in range(n)]


@pytest.mark.parametrize("width", [1, 2, 4, 6, 9])
def test_any_block_and_chunk(spark, width):
    run(spark, points(300), width=width, rows=17)


def test_copies_and_ties(spark):
    same = [(1000 + i, [0.25] * 6) for i in range(400)]
    run(spark, points(100) + same + [(5, [0.25] * 6), (5, [0.5] * 6), (5, [0.5] * 6)], rows=64)
    run(spark, [(i, [float(i % 2)] * 6) for i in range(40)])
    run(spark, same)


def test_vectors_that_do_not_count(spark):
    odd = [(1, None), (2, []), (3, [0.1] * 5), (4, [0.1] * 7), (5, [0.1] * 5 + [None]), (6, [float("nan")] + [0.1] * 5), (7, [float("inf")] * 6)]
    got = run(spark, points(60) + odd + [(None, [0.3] * 6), (None, None)])
    assert len(got) == 61
    assert run(spark, odd) == []
    assert run(spark, []) == []
    assert len(run(spark, points(3))) == 3


def test_codes_give_back_the_vectors():
    rng = np.random.default_rng(9)
    values = rng.integers(-3, 3, (200, 7)).astype(np.int64)
    for width in (1, 3, 7):
        row = K._chunk(list(range(200)), values, width).to_pylist()[0]
        back = np.empty_like(values)
        for span, distinct, codes in K._blocks(row, 7, width):
            assert len({tuple(d) for d in distinct.tolist()}) == len(distinct)
            back[:, span] = distinct[codes]
        assert (back == values).all()


def test_components_too_large_for_exact_distances(spark):
    table = spark.createDataFrame([(1, [3e38] * 6, "x", 1)], SCHEMA)
    with pytest.raises(Exception, match="leave 64 bits"):
        K.report(table, dimensions=6)
