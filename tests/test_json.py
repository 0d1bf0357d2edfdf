"""JSON documents: against the YAML reader on the same texts, and against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cilode.functions.documents import documents
from cilode.functions.extract import ANY_LEVEL, FIXED_LEVELS, FIXED_STEPS, iterated_levels, step_options, tagged_levels
from cilode.sources import json as J

SCHEMA = "key string, text string, value int"


def frame(spark, texts):
    return spark.createDataFrame([(str(i), t, 1) for i, t in enumerate(texts)], SCHEMA)


def deep(rng, depth):
    """A nested value with wanted keys in all kinds of places."""
    kind = rng.random()
    if depth == 0 or kind < 0.2:
        return rng.choice([29, "30", "x", True, None, "2.5", -3, "", 31])
    if kind < 0.5:
        return [deep(rng, depth - 1) for _ in range(rng.randrange(4))]
    keys = rng.sample(["api-level", "API-Level", "a", "b c", "d'e", "jobs", "api_level"], rng.randrange(5))
    return {key: deep(rng, depth - 1) for key in dict.fromkeys(keys)}


def texts():
    rng = random.Random(3)
    held = [json.dumps({"jobs": deep(rng, 7), "x": deep(rng, 2)}) for _ in range(300)]
    held += [json.dumps(deep(rng, 4)) for _ in range(50)]
    chain = {"api-level": 28}
    for i in range(60):
        chain = [chain] if i % 3 else {"k": chain, "l": [{"api-level": [i]}]}
    held.append(json.dumps({"jobs": chain}))
    return held + ["", "{", '{"jobs": {"api-level": 1}', None, "null", '{"jobs": {"\\u0061pi-level": 12}}', '{"jobs": {}}']


@pytest.mark.parametrize("levels", [1, 4])
def test_deep_levels_are_those_of_the_yaml_reader(spark, levels):
    df = frame(spark, texts())
    got = sorted(map(tuple, J.deep_levels(df, "key", levels=levels).collect()))
    read = df.select("key", F.explode(tagged_levels(documents(F.col("text"), [ANY_LEVEL])["nodes"], 0)).alias("l"))
    want = {(r.key, r.source, r.api_level) for r in read.select("key", "l.source", "l.api_level").collect()}
    assert got == sorted(want) and len(got) > 100


def test_fixed_paths_are_those_of_the_yaml_reader(spark):
    values = [[29, "30", None, True, 29, "x"], {"b": 1, "a": 2}, "30", "", 7, None, [], {}, True]
    held = [json.dumps({"jobs": {"instrumented-test": {"strategy": {"matrix": {"api_level": v}}}}}) for v in values]
    steps = [
        [{"with": {"a-emulator-options": "x", "Emulator-Options": 7}}, {"run": 1}, {"with": {"emulator-options": False}}],
        [{"with": {"emulator-options": "first"}}, {"with": None}, {"with": {"emulator-options": "lost"}}],
        [{"with": "text"}, {"with": {"emulator-options": "lost"}}],
        [{"with": {}}, 5, [], {"with": {"emulator-options": None}}],
        {"with": {"emulator-options": "no list"}},
    ]
    held += [json.dumps({"jobs": {"instrumented-test": {"steps": s}}}) for s in steps] + ["", "[1]", None, '{"jobs": []}']
    df = frame(spark, held)
    read = df.select("key", documents(F.col("text"), [FIXED_LEVELS, FIXED_STEPS])["nodes"].alias("nodes"))
    levels = read.select("key", F.explode(iterated_levels(F.col("nodes"), 0)).alias("v"))
    assert sorted(map(tuple, J.fixed_levels(df, "key").collect())) == sorted(map(tuple, levels.collect()))
    options = read.select("key", F.explode(step_options(F.col("nodes"), 1)).alias("v"))
    got = J.step_options(df, "key").collect()
    assert sorted((r.key, r.emulator_option) for r in got) == sorted(map(tuple, options.collect()))
    by_place = {(r.key, r.step, r.position): r.emulator_option for r in got}
    assert by_place["9", 0, 0] == "7" and by_place["9", 0, 1] == "x" and by_place["9", 2, 0] == "False"


def test_differences_of_json(spark):
    df = frame(spark, ['{"jobs": {"api-level": 1, "api-level": 2}}', '{"jobs": {"api-level": 29.0}}', '{"jobs": {"api-level": 123456789012345678901}}'])
    assert J.deep_levels(df, "key").collect() == []


def test_nothing_there(spark):
    empty = frame(spark, ["x"]).limit(0)
    for found in (J.deep_levels, J.fixed_levels, J.step_options):
        assert found(empty, "key").collect() == []


def test_no_python_runs(spark):
    df = frame(spark, ['{"jobs": {"api-level": 1}}'])
    for found in (J.deep_levels, J.fixed_levels, J.step_options):
        plan = found(df, "key")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
