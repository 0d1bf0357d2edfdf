"""Texts of plain lines are read together, with the results of reading each."""

import random

import pyarrow as pa
import pytest
import yaml

from cilode.functions import documents as D
from cilode.functions import extract as E

LINES = [
    "a:", "a:", "b: 1", "- x", "- c: d", "- a:", "k: [1, {x: y}]", "# c", "", "on: yes", "z: 'q' # c", "- {a: b, c}", "e: -no x",
    "t: 1:30", "g: a #b", "null: 1", "- 08:", "q: |", "k: {a: [b, c], d: }", "jobs:", "- jobs:", "api-level: 21", "a: 007", "b: 0",
    "API-LEVEL: [1, 2, '3']", "- api-level: {a: 1}", "w: {x: {api-level: 7}, api-level: [8]}", "c: yes", "b: No", "- 12", "- 1.5",
    "x: [{api-level: 1}, {y: {api-level: 2}}, 3]", "- 2020-01-01", "- 2020-13-01", "v: on", "yes: 3", "a: -5 b", "a: -5", "c:   ",
    "c: x  ", "c: 12345678901234567890", "é: 1", "a: b\\c", "a: b: c", "  ", "p: [?]", "r: a?b", "m: [a",
]
PATTERNS = (
    ("a",), ("a", D.EACH, "a"), E.ANY_LEVEL, (D.DEEP, "a"), ("jobs", D.EACH, D.DEEP, "api-level"), ("a", "~a"), ("jobs", D.EACH, "~b"),
    (D.EACH,), ("k", "a"), ("a", D.EACH, D.EACH, "x"), E.FIXED_STEPS,
)


def rows(block):
    return block.to_pylist()


def row(text, patterns):
    if text is None:
        return None
    head, nodes = D.read_document(text, patterns)
    named = [dict(zip([name for name, _ in D._NODE_FIELDS], node)) for node in nodes]
    return dict(zip([name for name, _ in D._DOCUMENT_FIELDS], head)) | {"nodes": named}


def texts(rng, n):
    for _ in range(n):
        lines = ["jobs:"] if rng.random() < 0.5 else []
        column = 2 * len(lines)
        for _ in range(rng.randint(1, 8)):
            line = rng.choice(LINES)
            lines.append(" " * column + line)
            if line.endswith(":") and rng.random() < 0.8:
                column += 4 if line.startswith("-") else 2
            else:
                column = max(0, column + rng.choice([0, 0, 0, 0, 2, -2, -2, 1, -4]))
        yield "\n".join(lines)


@pytest.mark.parametrize("seed", range(4))
def test_blocks_give_what_each_text_gives(seed):
    left = []

    def read(text, patterns):
        left.append(text)
        return D.read_document(text, patterns)

    given = [None, "", *texts(random.Random(seed), 2000), None]
    found = rows(D._read_block(pa.array(given), PATTERNS, read))
    assert len(given) - len(left) > 200
    for text, got in zip(given, found, strict=True):
        assert got == row(text, PATTERNS), text
    assert rows(D._read_block(pa.array(given[:50]), (), read)) == [row(text, ()) for text in given[:50]]
    assert rows(D._read_block(pa.array(given[:50]), ((), ("~a",)), read)) == [row(t, ((), ("~a",))) for t in given[:50]]


def test_plain_workflows_are_not_read_one_by_one():
    text = (
        "name: build {0} # c\non: push\njobs:\n  t:\n    matrix:\n      api-level: [{0}, \"7\", 1.5]\n      exclude:\n"
        "        - api-level: {0}\n    steps:\n    - uses: a@v2\n      with:\n        API-Level: 30\n\n    - run: make {0} it\nz: off"
    )
    given = [text.format(i) for i in range(300)]
    found = rows(D._read_block(pa.array(given), (E.ANY_LEVEL, ("z",)), None))
    assert found == [row(text, (E.ANY_LEVEL, ("z",))) for text in given]


def test_batches_are_cut_by_bytes(monkeypatch):
    monkeypatch.setattr(D, "_BLOCK_BYTES", 40)
    given = pa.array(["a: 1", None, "b: " + "x" * 50, "c: 2", "d: 3", "e: [1, 2, 3, 4, 5, 6, 7, 8, 9]", ""])
    blocks = D._blocks(given)
    assert len(blocks) > 2 and pa.concat_arrays(blocks).equals(given)
    found = [x for block in blocks for x in rows(D._read_block(block, (("c",),), D.read_document))]
    assert found == [row(text, (("c",),)) for text in given.to_pylist()]


def said(load, text):
    try:
        return repr(load(text))
    except Exception as failure:
        return type(failure), str(failure)


@pytest.mark.parametrize(
    "text", ["on: push\njobs: [1, 7\nrun: adb", "a: {b: [c, d", "a: {b: c\n", "[a, b # c", "x: {a: 1\ny: 2\nz:"]
)
def test_open_brackets_take_no_second_load(text, monkeypatch):
    expected = said(yaml.safe_load, text)
    monkeypatch.setattr(yaml, "load", None)
    assert said(D.load, text) == expected


def test_messages_of_open_brackets():
    rng = random.Random(1)
    pieces = ["[", "{", "]", "}", ",", " ", "\n", "a", "b: 1", "c:", "- ", "'q'", '"q"', "\n  ", "7", "x: [1, ", "#c", " # d", ": ", "? ",
              "|", ">", "&a ", "*a", "-", "\n- ", "--- ", "...\n", "on: push\n", "jobs: {a: [", "%", "é", "\x85", ":x", "!t "]
    for _ in range(4000):
        text = rng.choice(["", "k: [", "k: {", "a: 1\nb: ["]) + "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))
        assert said(D.load, text) == said(yaml.safe_load, text), text


def test_empty_documents_and_texts_given_up_are_not_read_twice(monkeypatch):
    given = ["# a", "", "\n  # a\n\n#b", "# a\na: 1", "---\na: 1", "a: [1"] * 2
    want = [row(text, (("a",),)) for text in given]

    def tried(text):
        raise AssertionError(f"read by lines again: {text}")

    def read_other(text, patterns):
        others.append(text)
        return D.read_document(text, patterns, False)

    others = []
    monkeypatch.setattr(D, "_plainly", tried)
    assert rows(D._read_block(pa.array(given), (("a",),), None, read_other)) == want
    assert others == ["---\na: 1", "a: [1"] * 2


def test_values_of_equal_lines_are_searched_once(monkeypatch):
    texts_, searched = [f"n: {i}\njobs: {{api-level: [{i % 3}, x]}}" for i in range(300)], []
    search = D._searched
    monkeypatch.setattr(D, "_searched", lambda *args: searched.append(args) or search(*args))
    assert rows(D._read_block(pa.array(texts_), (E.ANY_LEVEL,), None)) == [row(text, (E.ANY_LEVEL,)) for text in texts_]
    assert len(searched) == 3


def test_kept_lines_tell_what_they_told_before():
    D._FLOWS.clear()
    given = ["a: [x?, y]", "a: 1\nb: {c: 2}", "k:\n  a: [x?, y]", "b: {c: 2}"]
    for _ in range(2):
        assert rows(D._read_block(pa.array(given), (("a",),), D.read_document)) == [row(text, (("a",),)) for text in given]
    assert "b: {c: 2}" in D._FLOWS
