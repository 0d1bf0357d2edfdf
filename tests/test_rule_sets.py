"""Label sets as bitmaps, for more rules than a struct of flags holds."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cilode.operators import rule_sets as B
from cilode.operators.labelling import match_rules

RULES = [(f"l{i:04d}", f"word {i:04d} end") for i in range(1200)] + [("l0003", "other"), ("l0003", None), (None, "word"), ("unused", "nowhere")]


def frames(spark, n=400, seed=1):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        held = [f"word {rng.randrange(1200):04d} end" for _ in range(rng.randrange(12))] + ["other"] * (i % 9 == 0)
        docs.append((i, None if i % 50 == 0 else f"p{rng.choice([0, 0, 0, i % 7])}", None if i % 31 == 0 else " ".join(held)))
    return docs, spark.createDataFrame(docs, "id long, project string, text string"), spark.createDataFrame(RULES, "label string, keyword string")


def brute(docs):
    sets = {}
    for _, project, text in docs:
        found = {label for label, word in RULES if text and label and word and word in text}
        if found:
            sets.setdefault(project, set()).update(found)
    return sets


@pytest.mark.parametrize("parts", [1, 7])
def test_sets_of_projects(spark, parts):
    docs, texts, rules = frames(spark)
    labels = B.numbered_labels(rules)
    assert labels.count() == 1201
    sets = B.label_sets(B.matched_numbers(texts.repartition(parts), rules, labels, "id", "project"), "project")
    want = brute(docs)
    assert {r.project: r.n_labels for r in B.set_sizes(sets, "project").collect()} == {p: len(s) for p, s in want.items()}
    members = B.set_labels(sets, labels, "project")
    listed = {r.project: r["labels"] for r in B.labels_listed(members, "project").collect()}
    assert listed == {p: ", ".join(sorted(s)) for p, s in want.items()}
    one = B.united(sets.withColumn("all", F.lit(1)), "all")
    assert B.set_sizes(one, "all").first().n_labels == len(set().union(*want.values()))


def test_sets_merge_before_they_move(spark):
    _, texts, rules = frames(spark, 20)
    hits = spark.createDataFrame([("a", 1), ("a", 40)], "project string, number long")
    plan = B.label_sets(hits, "project")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "partial_bit_or" in plan and "SortAggregate" not in plan
    assert B.label_sets(hits.limit(0), "project").collect() == []


@pytest.mark.parametrize("windows", [0, 200_000])
def test_both_ways_to_match_give_the_same(spark, windows):
    docs, texts, rules = frames(spark)
    got = {(r.id, r.label) for r in match_rules(texts, rules, "id", broadcast_windows=windows).collect()}
    assert got == {(i, label) for i, _, t in docs for label, word in RULES if t and label and word and word in t}


def test_no_text_moves_where_windows_are_few(spark):
    _, texts, rules = frames(spark, 50)
    plan = match_rules(texts, rules, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert set(re.findall(r"Join \[(\w+)#", plan)) == {"window", "keyword"}
