"""Fill-in-the-middle: forms and cuts against plain slices, rotations against concatenation, exact round trips."""

import hashlib
import random

import pytest

from cilode.llm import fim as M

SCHEMA = "doc_id long, text string, output string, form int, first string"


def expected(doc_id, text):
    """Form, cuts and output by slices of the text."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = "<P>" + text[:a], "<M>" + text[a:b], "<S>" + text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, suffix + prefix + middle
    return n, "psm", a, b - a, prefix + suffix + middle


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    made = M.restored(M.transformed(docs)).collect()
    assert sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output.decode()) for r in made))) == sorted(
        map(repr, ((i, *expected(i, t)) for i, t in rows))
    )
    assert sorted(r.restored.decode() for r in made) == sorted(t or "" for _, t in rows)
    digests = M.report(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((r.output_sha256, r.restored_sha256) for r in digests.collect()) == sorted(
        (sha(expected(i, t)[-1]), sha(t or "")) for i, t in rows
    )


def test_texts_of_all_kinds(spark):
    rng = random.Random(4)
    letters = ["a", "b", " ", "\n", "é", "ß", "中", "\U0001f600", "<", ">", "P>", "<S", "\x00", "́"]
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(60)))) for i in range(600)]
    rows += [(1000 + i, "text with <M> inside " * i) for i in range(40)] + [(2000 + i, "<P") for i in range(40)]
    forms = {expected(*row)[1] for row in rows}
    assert forms == {"plain", "psm", "spm"}
    run(spark, rows)


def test_nulls_empty_texts_and_repeated_rows(spark):
    run(spark, [(None, "no id"), (None, None), (1, None), (2, ""), (3, "same"), (3, "same"), (3, "other"), (4, "x")])


def test_very_long_texts(spark):
    run(spark, [(i, unit * 300_000) for i, unit in enumerate(["ab ", "é中", "\U0001f600a", "xyz"], 7)])


def test_an_empty_table(spark):
    run(spark, [])


def test_rotations_in_place(monkeypatch):
    rng = random.Random(5)
    for block in (1, 3, 1 << 16):
        monkeypatch.setattr(M, "BLOCK", block)
        for _ in range(300):
            held = bytes(rng.randrange(256) for _ in range(rng.randrange(40)))
            a, b, c = sorted(rng.randint(0, len(held)) for _ in range(3))
            buffer = bytearray(held)
            M.rotate(buffer, a, b, c)
            assert buffer == held[:a] + held[b:c] + held[a:b] + held[c:]
            M.rotate(buffer, a, a + c - b, c)
            assert buffer == held


@pytest.mark.parametrize("block", [1, 2, 5, 1 << 16])
def test_places_of_cuts(monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    for text in ("", "abc", "é", "aé中\U0001f600b", "中中中"):
        for a in range(len(text) + 1):
            for b in range(a, len(text) + 1):
                assert M.places(text.encode(), a, b) == (len(text[:a].encode()), len(text[:b].encode()))


def test_every_cut_comes_back():
    for text in ("", "ab", "<", "<P", "é>", "<<M", "S><S"):
        for a in range(len(text) + 1):
            for b in range(a, len(text) + 1):
                for form in ("plain", "psm", "spm"):
                    assert M.restore(M.transform(text.encode(), form, a, b), form) == text.encode()


def test_texts_go_to_python_once(spark):
    docs = spark.createDataFrame([(i, "some text " * 9, "x", 1, "y") for i in range(40)], SCHEMA)
    plan = M.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    made = ["doc_id", "form", "prefix_chars", "middle_chars", "output", "restored"]
    one, two = M.there_and_back(docs).select(made), M.restored(M.transformed(docs)).select(made)
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
