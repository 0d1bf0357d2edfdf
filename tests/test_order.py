"""Places in a total order, by ranges."""

import random

import pytest
from pyspark.sql import functions as F

from cilode.operators.order import numbered, with_sums_before

SCHEMA = "k string, n long, number2 int"


def rows(count, kinds, seed=1):
    rng = random.Random(seed)
    return [(rng.choice([None, "", "é", "a"]) if i % 50 == 0 else f"{rng.randrange(kinds):04d}", rng.randrange(9), i) for i in range(count)]


def key(value):
    return (value is not None, (value or "").encode())


@pytest.mark.parametrize("count, kinds", [(0, 1), (1, 1), (500, 3), (3000, 4000)])
def test_numbers(spark, count, kinds):
    held = rows(count, kinds)
    got = numbered(spark.createDataFrame(held, SCHEMA).repartition(5), ["k", "n"]).collect()
    assert sorted(r.number for r in got) == list(range(count))
    got.sort(key=lambda r: r.number)
    assert [(r.k, r.n) for r in got] == sorted(((k, n) for k, n, _ in held), key=lambda r: (key(r[0]), r[1]))
    assert sorted((r.number2 for r in got)) == list(range(count))


@pytest.mark.parametrize("count", [0, 1, 2000])
def test_sums_before(spark, count):
    held = rows(count, 700)
    df = spark.createDataFrame(held, SCHEMA)
    got = with_sums_before(df, ["k", "number2"], {"bytes": F.col("n"), "rows": F.lit(1)}).collect()
    want, total = [], 0
    for i, (k, n, at) in enumerate(sorted(held, key=lambda r: (key(r[0]), r[2]))):
        want.append((at, total, i))
        total += n
    assert sorted((r.number2, r.bytes, r.rows) for r in got) == sorted(want)


def test_no_task_sorts_everything(spark):
    df = numbered(spark.createDataFrame(rows(100, 50), SCHEMA), ["k"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan and "Python" not in plan
