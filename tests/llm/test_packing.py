"""Packing: ids against the tokenizer, gapless sequences, and the curve."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from cilode.llm import packing as P
from cilode.llm import word_ids as W

SCHEMA = "doc_id long, text string, row int, ids string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.vocabulary_path(P.VOCABULARY))


def texts():
    rng = random.Random(3)
    pieces = [
        "The", "don't", "we'll", "'s", "x1234", "é", "Éa", "straße", "ÀÖÿ", "÷", "×", "<|endoftext|>", "<|", "\U0001f600", "é", " ",
        "\n", "\t", "\x0b", "\x1c", "\xa0", " ", "ß'd", "...", "«a»", "¿qué?", "中文", "\x00", "İ", "Σ", "µ", "²", "a_b", "--",
    ]
    made = ["".join(rng.choice(pieces) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "Delta,"]) for _ in range(30_000))
    return made + [None, "", " ", long, "中 " * 70_000]


def test_ids_are_those_of_the_tokenizer(tokenizer, monkeypatch):
    held = [text or "" for text in texts()]
    want = [tokenizer.encode(text, add_special_tokens=False).ids for text in held]
    for kept, chunk in ((300_000, 1 << 17), (50, 40)):
        monkeypatch.setattr(W, "_KEPT", kept)
        monkeypatch.setattr(W, "_CHUNK", chunk)
        encoder = W.WordIds(P.vocabulary_path(P.VOCABULARY))
        assert [encoder.ids(text).tolist() for text in held] == want


def test_ids_of_another_vocabulary():
    """Its cut is not the known one, so texts go through it whole."""
    path = P.vocabulary_path("byte_bpe_50k.json")
    tokenizer, encoder = Tokenizer.from_file(path), W.WordIds(path)
    for text in ["Hello World, this is 2024. a  b", *[t or "" for t in texts()]]:
        assert encoder.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check(rows, pieces, tokenizer, length):
    want = sorted(tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t, *_ in rows)
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
    full = 0
    for held in by_sequence.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
        full += at == length
    assert full >= len(by_sequence) - 1 and sum(p.length for p in pieces) == sum(map(len, want))
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for doc_id, text, *_ in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        mine = [p for p in by_doc[doc_id] if p.doc_tokens == len(ids)]
        starts = {p.start for p in mine}
        assert 0 in starts
        for p in mine:
            if p.start + p.length <= len(ids) and len(by_doc[doc_id]) == len(mine):
                assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32


@pytest.mark.parametrize("length", [64, 4096])
def test_packed(spark, tokenizer, length):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts())] + [(10**9, texts()[5], 1, "x")] * 3
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    pieces = P.packed(docs, length=length).collect()
    check(rows, pieces, tokenizer, length)
    assert P.packed(docs.where("false")).collect() == []


def test_pack_round_trip():
    for ids in ([], [0], [65535], [65536, 1], list(range(70_000))):
        assert P.unpack(P.pack(np.array(ids, np.uint32))).tolist() == ids


@pytest.mark.parametrize("dimensions,bits", [(2, 4), (3, 3)])
def test_curve_visits_neighbours(dimensions, bits):
    axes = np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij")
    cells = np.stack([a.ravel() for a in axes], axis=1)
    keys = P.hilbert(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_alike_documents_are_neighbours():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 40_000, 500) for _ in range(2))
    near = a.copy()
    near[:10] = rng.integers(0, 40_000, 10)
    table = P.directions(1 << 16)
    point = lambda ids: P.projection(ids, table)
    assert np.abs(point(a) - point(near)).max() < np.abs(point(a) - point(b)).max()
