"""Decontamination against a plain search for every window."""

import hashlib
import random
import re

from cilode.llm import decontaminate as D

DOCS = "doc_id long, text string, matches string, n_words int"


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(text, items):
    held, hit, found = words(text), set(), set()
    for item, other in items:
        sought = words(other)
        width = min(10, len(sought))
        for k in range(len(sought) - width + 1 if sought else 0):
            for i in range(len(held) - width + 1):
                if held[i : i + width] == sought[k : k + width]:
                    hit.update(range(i, i + width))
                    found.add(str(item))
    return len(held), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def fixture():
    rng = random.Random(6)
    vocabulary = ["Alpha", "b2", "é", "naïve", "x", "0", "Ω", "\U0001f600"]
    make = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "-", "\n", "__"]) for _ in range(n))
    items = [(i, make(rng.choice([1, 2, 3, 9, 10, 11, 25]))) for i in range(30)] + [(40, None), (41, "..."), (42, "")]
    items += [(43, items[5][1]), (7, "x y z")]
    docs = [make(rng.randint(0, 60)) for _ in range(60)]
    docs += [make(5) + items[i][1].upper() + make(5) for i in range(30)] + [None, "", "!?", items[3][1] * 50]
    return [(i, t, "m", 0) for i, t in enumerate(docs)] + [(3, docs[3], "m", 0), (None, items[4][1], None, None)], items


def test_report(spark):
    rows, items = fixture()
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.report(docs, bench).collect()]
    want = [(r[0], *plain(r[1], items)) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not w[-1] for w in want)


def test_blocks_give_the_same(spark):
    rows, items = fixture()
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    assert len(list(D.blocks(bench, "item_id", ["text"], 100))) > 5
    one, many = (
        sorted((r.doc_id or -1, sorted({i for m in r.found for i in m["items"]})) for r in D.matched(docs, bench, chars=n, into="found").collect())
        for n in (D.BLOCK_CHARS, 100)
    )
    assert one == many


def test_hits_of_all_blocks_are_put_together(spark):
    rows, items = fixture()
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    found = D.matched(docs, bench, chars=60, into="found")
    assert found.columns == [*docs.columns, "found"]
    got = {(r.doc_id, r.text): r.found for r in found.collect()}
    assert found.count() == len(rows) and max(len(f) for f in got.values()) > 2
    for doc_id, text, *_ in rows:
        hit = {w for m in got[doc_id, text] for a, b in zip(m.firsts, m.lasts) for w in range(a, b + 1)}
        n_words, n_hit, *_ = plain(text, items)
        assert got[doc_id, text][0].n_words == n_words and len(hit) == n_hit


def test_a_very_long_text(spark):
    """Millions of characters, with one passage near the end."""
    text = "filler wörds and " * 200_000 + "The passage, that ONLY the benchmark has; ten words or more of it." + " tail" * 10
    items = [(1, "the passage that only the benchmark has ten words or more of it")]
    docs, bench = spark.createDataFrame([(1, text, "m", 0)], DOCS), spark.createDataFrame(items, "item_id long, text string")
    [row] = D.report(docs, bench).collect()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (600_000 + 13 + 10, 13, 1, True)


def test_offsets_lead_back_to_the_text(spark):
    bench = spark.createDataFrame([(1, "ÄPFEL und birnen")], "item_id long, text string")
    text = "\U0001f600 ab, Äpfel... und ÄPFEL -- UND\nBirnen! ÄPFEL und birnen"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    [match] = D.matched(docs, bench).first().matches
    assert [text[a:b] for a, b in zip(match.starts, match.ends)] == ["ÄPFEL -- UND\nBirnen! ÄPFEL und birnen"]
    assert (match.firsts, match.lasts) == ([4], [9])


def test_empty_tables(spark):
    rows, items = fixture()
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    assert D.report(docs.where("false"), bench).collect() == []
    assert not any(r.contaminated for r in D.report(docs, bench.where("false")).collect())
    assert D.clean(docs, bench.where("false")).count() == len(rows)
