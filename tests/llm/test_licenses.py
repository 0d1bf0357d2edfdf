"""License scans: base phrases against plain Python, quotations with edits."""

import random
import re

from cilode.llm import licenses as L

SCHEMA = "doc_id long, text string, labels string, at int"


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def base(text):
    held = words(text)
    found = [(i, label) for phrase, label in L.PHRASES.items() for i in range(len(held)) if tuple(held[i : i + len(phrase)]) == phrase]
    at = [i for i, _ in found]
    return len(held), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({n for _, n in found}))


def fixture():
    rng = random.Random(5)
    pieces = ["MIT", "License", "mit license", "Apache", "GENERAL PUBLIC", "license", "licence", "é", "İ", "K", "x-y", "_", "general", "public"]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", "\n", ", ", "/"]) for _ in range(rng.randint(0, 30))) for _ in range(150)]
    texts += [None, "", "!!", "mit license " * 5000]
    rows = [(i, t, "l", 1) for i, t in enumerate(texts)]
    return rows + [rows[0], (None, "The MIT License", None, None), (3, "mit license", "l", 1)]


def test_base_columns(spark):
    rows = fixture()
    got = L.report(spark.createDataFrame(rows, SCHEMA)).collect()
    found = sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=repr)
    assert found == sorted([(r[0], *base(r[1])) for r in rows], key=repr)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def filler(n, seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(1000)}" for _ in range(n))


def quoted(spark, text):
    [row] = L.report(spark.createDataFrame([(1, text, "", 0)], SCHEMA)).collect()
    return row.labels, row.score


def test_quotations_survive_edits(spark):
    long = max((t for _, t in L.TEMPLATES), key=len).split()
    label = next(name for name, t in L.TEMPLATES if t.split() == long)
    assert quoted(spark, filler(40, 1) + " " + " ".join(long).upper() + " " + filler(40, 2)) == (label, 1.0)
    edited = long[:20] + ["added", "words"] + long[20:40] + long[41:]
    labels, score = quoted(spark, filler(9, 3) + "\n" + "\n# ".join(edited) + "\n" + filler(9, 4))
    assert labels == label and 0.7 < score < 1
    assert quoted(spark, filler(50, 5) + " ".join(long[:15]) + filler(50, 6)) == ("", 0.0)
    # The same words far apart do not add up.
    apart = (" " + filler(30, 7) + " ").join(" ".join(long[i : i + 6]) for i in range(0, len(long), 6))
    assert quoted(spark, apart)[0] == ""


def test_every_template_is_found(spark):
    rows = [(i, f"Xx {t} yy", "", 0) for i, (_, t) in enumerate(L.TEMPLATES)]
    for r in L.report(spark.createDataFrame(rows, SCHEMA)).collect():
        assert L.TEMPLATES[r.doc_id][0] in r.labels.split(",") and r.score == 1.0


def plain_quotations(text, templates):
    """Labels and best score by lists of matching places: diagonals, their runs, and distinct places."""
    held = words(text)
    grams = lambda w: [tuple(w[i : i + L.K]) for i in range(len(w) - L.K + 1)]
    found = []
    for number, (label, template) in enumerate(templates):
        wanted = grams(words(template))
        matches = sorted((a - t, a, t) for a, g in enumerate(grams(held)) for t, w in enumerate(wanted) if g == w)
        runs = []
        for match in matches:
            if not runs or match[0] - runs[-1][-1][0] > L.NEIGHBOURS:
                runs.append([])
            runs[-1].append(match)
        for run in runs:
            at, places = {a for _, a, _ in run}, {t for _, _, t in run}
            covered = min(len(at), len(places))
            if covered >= L.COVERED * len(wanted) and covered >= L.DENSE * (max(at) - min(at) + 1):
                found.append((min(at), -covered / len(wanted), -len(wanted), number, label))
    best = {}
    for row in sorted(found):
        best.setdefault(row[0], row)
    return {row[4] for row in best.values()}, max((-row[1] for row in best.values()), default=0.0)


def test_labels_and_scores_against_plain_lists(spark):
    rng = random.Random(11)
    templates = [*L.TEMPLATES, ("chant", "na na na na na na na na hey hey hey goodbye"), ("echo", "one two three four one two three four one two three four five")]
    texts = ["na " * 50 + "hey hey hey goodbye", "one two three four " * 9 + "five", "", None]
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(4)):
            held = words(rng.choice(templates)[1])
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(held))
                held[at : at + rng.randrange(3)] = rng.choice([[], ["new"], held[at : at + 5], ["two", "words"]])
            a, b = sorted((rng.randrange(len(held) + 1), rng.randrange(len(held) + 1))) if rng.random() < 0.3 else (0, len(held))
            parts += [" ".join(held[a:b]), filler(rng.randrange(12), rng.random())]
        texts.append("\n".join(parts))
    docs = spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in L.report(docs, tuple(templates)).collect()}
    several = 0
    for i, text in enumerate(texts):
        labels, score = plain_quotations(text, templates)
        assert set(filter(None, got[i].labels.split(","))) == labels | set(filter(None, base(text)[4].split(",")))
        assert abs(got[i].score - score) < 1e-9
        several += len(labels) > 1
    assert several > 10


def test_the_nearest_of_a_family_is_named(spark):
    notice = dict((text, label) for label, text in L.TEMPLATES)
    text = next(t for t in notice if "ShareAlike" in t)
    assert quoted(spark, f"{filler(8, 1)} {text} {filler(8, 2)}") == ("cc-by-sa", 1.0)


def test_repeated_rows_do_not_vote_twice(spark):
    half = " ".join(words(L.TEMPLATES[1][1])[:30])
    rows = [(1, half, "", 0)] * 5
    assert {r.labels for r in L.report(spark.createDataFrame(rows, SCHEMA)).collect()} == {""}


def test_empty_table_and_plan(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert L.report(docs).collect() == []
    plan = L.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
