"""Quality rules against a plain Python version."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from cilode.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_words string"


def plain(text):
    text = text or ""
    held = WORD.findall(text)
    places = defaultdict(list)
    for i in range(len(held) - 7):
        places[tuple(held[i : i + 8])].append(i)
    marked = {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    failed = len(held) < 20 or 100 * len(marked) > 30 * len(held)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(held), sum(map(len, held)), symbols, repeated, len(marked), failed


def odd_texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)] + ["é", "#*", " x", "\U0001f600"]
    texts = [None, "", " \n\t", "one", "a b " * 40, "x " * 19, "x " * 20, " ".join(map(str, range(20))), "A" * 5000]
    texts += ["same line here\n" * 3 + " ".join(map(str, range(30))), "l\r\nl\r\nl", "#" * 100 + " y" * 30]
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        texts.append("".join(w + rng.choice([" ", "\n", "\t", "\x0b", " \r\n"]) for w in words))
    texts.append(" ".join(f"u{i}" for i in range(30_000)) + " again and again" * 20)
    return texts


def test_statistics_and_verdict(spark):
    texts = odd_texts()
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(1, "", "clash"), (None, "a", None)]
    got = Q.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for row in got:
        text = texts[row.doc_id] if row.doc_id is not None else "a"
        want = plain(text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want[:5], text
        assert row.base_failed == want[5] and not (want[5] and row.kept)


def test_order_does_not_change_the_verdict(spark):
    rules = Q.base_rules(F.col("text")) + Q.further_rules(F.col("text"))
    docs = spark.createDataFrame([(i, t, "") for i, t in enumerate(odd_texts())], SCHEMA)
    verdicts = [
        [r.bad for r in docs.select("doc_id", Q.rejected_by(order).isNotNull().alias("bad")).orderBy("doc_id").collect()]
        for order in (rules, rules[::-1])
    ]
    assert verdicts[0] == verdicts[1] and len(set(verdicts[0])) == 2
    kept = {r.doc_id for r in Q.good(docs).collect()}
    assert kept == {i for i, bad in enumerate(verdicts[0]) if not bad}


def test_cascade_prefers_rejections_per_second():
    rules = [Q.Estimate(Q.Rule(n, None), s, r) for n, s, r in (("dear", 9.0, 0.9), ("cheap", 0.1, 0.1), ("idle", 0.01, 0.0))]
    assert [r.name for r in Q.cascade_order(rules)] == ["cheap", "dear", "idle"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert Q.report(docs).collect() == [] and Q.good(docs).collect() == []
    assert Q.good(docs).columns == docs.columns
