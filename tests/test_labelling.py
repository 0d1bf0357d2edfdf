"""Keyword rules: the four variants, and the rule join against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from cilode.functions import rules as L
from cilode.operators import labelling as O


def types(spark, texts, rules=L.RULES_V2, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    out = O.with_labels(df, rules, **how).select("i", L.labels_text(F.col("labels"), rules).alias("t"))
    return [row.t for row in out.orderBy("i").collect()]


def test_variants(spark):
    text = ["run: ./gradlew connectedAndroidTest", "a: 1\n # create avd\nb: x # Create AVD", "a: 1\n # create avd\n",
            "browserstack, create avd", "connectedcheck", None, "", "gcloud firebase test android run"]
    assert types(spark, text) == [
        "GitHub_gradle", "GitHub_emulator_manual", "none", "GitHub_emulator_manual, browserstack_test",
        "GitHub_gradle", "none", "none", "firebase_test_lab"]
    assert types(spark, text, strip_comments=False)[1:3] == ["GitHub_emulator_manual"] * 2
    assert types(spark, text, fold_keywords=False) == [
        "none", "GitHub_emulator_manual", "none", "GitHub_emulator_manual, browserstack_test",
        "GitHub_gradle", "none", "none", "firebase_test_lab"]
    assert types(spark, ["ADB_INSTALL_TIMEOUT: 8", "microsoft/appcenter-test-cli-action"], L.RULES_V1) == [
        "emulator_ci", "appcenter_test"]


def test_labels_outside_comments_are_those_of_the_stripped_text(spark):
    rng = random.Random(11)
    pieces = ["\n", "\r", "\x0b", "\x85", chr(0x2028), " ", "\xa0", "\t", "#", "# ", "a+b", "(x", "A+B", "y", "", "\\E", "é"]
    rules = {"plus": ["a+b", "zz"], "open": ["(x", "\\E"], "space": [" y"], "hash": ["#y", "# "], "none": []}
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    bare = ["\n".join(x for x in t.splitlines() if not x.strip().startswith("#")) for t in texts]
    for fold in (True, False):
        got = types(spark, texts, rules, fold_keywords=fold)
        assert got == types(spark, bare, rules, fold_keywords=fold, strip_comments=False)
        assert len(set(got)) > 8


def test_other_columns_survive(spark):
    df = spark.createDataFrame([(1, "create avd", "x")], "i int, text string, `odd.name` string")
    [row] = O.with_labels(df, L.RULES_V2).collect()
    assert (row["i"], row["text"], row["odd.name"], row["labels"]["GitHub_emulator_manual"]) == (1, "create avd", "x", True)


def test_every_keyword_counts_alone(spark):
    for rules in (L.RULES_V1, L.RULES_V2):
        words = [(label, word) for label, ws in rules.items() for word in ws]
        for (label, word), found in zip(words, types(spark, [w.upper() for _, w in words], rules)):
            assert label in found.split(", "), word


def test_effective_keywords():
    assert L.effective_keywords(["adb", "adb shell", "X", "x y"], fold=True) == ["adb", "x"]
    assert L.effective_keywords(["adb", "adb shell", "X", "x y"], fold=False) == ["adb", "x y"]


def test_keywords_over_lines_are_refused(spark):
    for word in ("a\nb", "a\rb", "a\x85b", "\x0c"):
        with pytest.raises(ValueError):
            O.with_labels(spark.createDataFrame([("a",)], "text string"), {"l": [word]})


def test_empty_keyword_is_in_every_text(spark):
    assert types(spark, ["# a", "", "b"], {"l": ["", "b"], "n": []}) == ["l", "l", "l"]


def rule_join_fixture(spark):
    rng = random.Random(3)
    alphabet = ["ab", "c", "é", chr(0x1F600), " ", "\n", "common prefix of many keywords "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    texts += ["common prefix of many keywords c"] * 100  # a third of all texts are copies
    words = ["", "a", "ab", "bc", "éab", "cccc", chr(0x1F600), "c" + chr(0x1F600), "zzz", "not there at all"]
    words += ["common prefix of many keywords " + w for w in ("a", "c", "ab ", "éé", "zzz", "\n")]
    words += [t[a : a + n] for t in texts[:40] for a, n in [(rng.randint(0, 20), rng.randint(1, 25))] if t[a : a + n]]
    rules = [(f"l{i % 7}", w) for i, w in enumerate(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = sorted({(i, label) for i, t in enumerate(texts) for label, w in rules if w in t})
    return docs, spark.createDataFrame(rules + [(None, "a"), ("x", None)], "label string, keyword string"), want


def both_ways(docs, rules):
    listed = O.match_rules_constant(docs, O.rule_list(rules), "id", label_type=rules.schema["label"].dataType)
    joined = O.match_rules(docs, rules, "id")
    assert listed.schema.simpleString() == joined.schema.simpleString()
    rows = sorted(map(tuple, joined.collect()), key=repr)
    assert sorted(map(tuple, listed.collect()), key=repr) == rows
    return rows


def test_rule_join(spark):
    docs, rules, want = rule_join_fixture(spark)
    assert both_ways(docs, rules) == sorted(want, key=repr)


def test_constant_rules_move_no_text(spark):
    docs, rules, _ = rule_join_fixture(spark)
    text = O.match_rules_constant(docs, O.rule_list(rules), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text


def test_rule_join_without_broadcast(spark):
    docs, rules, want = rule_join_fixture(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = O.match_rules(docs, rules, "id")
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, joined.collect())) == want
        null_keys_and_repeats(spark)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def null_keys_and_repeats(spark):
    docs = spark.createDataFrame(
        [(1, "a long phrase"), (1, "a long phrase"), (1, "b"), (None, "a long phrase"), (None, "b"), (2, None)],
        "id int, text string",
    )
    rules = spark.createDataFrame([(7, "long phrase"), (8, "b"), (7, "b"), (9, "zz")], "label bigint, keyword string")
    assert both_ways(docs, rules) == sorted([(1, 7), (1, 8), (None, 7), (None, 8)], key=repr)


def test_rule_join_null_keys_and_repeats(spark):
    null_keys_and_repeats(spark)


def test_long_rule_tables_are_refused_as_constants(spark, monkeypatch):
    _, rules, _ = rule_join_fixture(spark)
    monkeypatch.setattr(O, "MAX_CONSTANT_RULES", 5)
    with pytest.raises(ValueError, match="match_rules"):
        O.rule_list(rules)


def test_no_rules(spark):
    docs, rules, _ = rule_join_fixture(spark)
    empty = rules.where("false").selectExpr("cast(label AS bigint) AS label", "keyword")
    assert both_ways(docs, empty) == [] and O.match_rules(docs, empty, "id").schema["label"].dataType.simpleString() == "bigint"


def test_windows_travel_without_texts(spark):
    docs, rules, _ = rule_join_fixture(spark)
    plan = O.match_rules(docs, rules, "id")._jdf.queryExecution().optimizedPlan().toString()
    generated = [line for line in plan.splitlines() if "Generate explode" in line]
    assert generated and all("text#" not in line.split("Generate explode")[1].split("]")[0] for line in generated)
