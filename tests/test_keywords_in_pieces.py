"""Keywords with several words are looked for around their rarest word, not in the whole text."""

import random

import pytest

from cilode.operators.labelling import match_rules


def frames(spark):
    rng = random.Random(9)
    words = ["a", "b", "ab", "é", "", "the", "rare", "a\n", chr(0x1F600)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(300)] + [None, "", "a b " * 200]
    rules = [(i % 9, " ".join(rng.choice(words) for _ in range(rng.randint(1, 7)))) for i in range(150)]
    rules += [(9, t[a : a + n]) for t in texts[:60] for a, n in [(rng.randint(0, 20), rng.randint(1, 30))] if t[a : a + n]]
    rules += [(10, "b a b a b"), (11, " a b a b "), (12, "rare " * 40), (13, "   "), (14, "a b b a")]
    docs = [(i // 2 if i % 7 else None, t) for i, t in enumerate(texts)]
    want = {(i, label) for i, t in docs for label, word in rules if t is not None and word in t}
    return spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(rules, "label int, keyword string"), want


@pytest.mark.parametrize("windows", [0, 200_000])
def test_all_keywords_are_found(spark, windows):
    docs, rules, want = frames(spark)
    got = [tuple(row) for row in match_rules(docs, rules, "id", broadcast_windows=windows).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_words_are_compared_where_they_stand(spark):
    docs, rules, _ = frames(spark)
    phrases = rules.where("keyword = 'a b b a' or keyword like 'rare rare%'")
    plan = match_rules(docs, phrases, "id")._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" in plan and "Contains" not in plan and "Python" not in plan
