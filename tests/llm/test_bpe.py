"""BPE ids and texts against the tokenizers library, on two vocabularies."""

import hashlib
import random
from array import array

import pytest
from tokenizers import Tokenizer
from tokenizers.models import BPE

from cilode.llm import bpe as B
from cilode.llm.packing import vocabulary_path

SCHEMA = "doc_id long, text string, ids string, n_tokens int, decoded int"
FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def texts():
    rng = random.Random(6)
    pieces = [
        "The", "don't", "we'LL", "'s", "x1234", "é", "Éa", "straße", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "\U0001f600", "é",
        " ", "\n", "\t", "\x0b", "\x1c", "\x7f", "\xa0", "\x85", " ", "...", "¿qué?", "中文", "\x00", "İ", "Σ", "²", "--", "</w>", "w>",
    ]
    made = ["".join(rng.choice(pieces) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    for letters in ("ab", "aab", "abcdeinotrs", "!.-=_#*", "eéèthe "):
        made += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 50))) for _ in range(300)]
    long = " ".join(rng.choice(["alpha", "beta", "Gamma", "delta,"]) for _ in range(30_000))
    return made + ["", " ", "\x85", "a" * 5000, "=-" * 3000, long, "中 " * 50_000, "x" * 200_000]


@pytest.mark.parametrize("name", FILES)
def test_ids_and_texts_are_those_of_the_library(name, monkeypatch):
    path = vocabulary_path(name)
    library, held = Tokenizer.from_file(path), texts()
    want = [library.encode(text, add_special_tokens=False).ids for text in held]
    back = [library.decode(ids, skip_special_tokens=False) for ids in want]
    for words, pairs, chunk in ((400_000, 1_000_000, 1 << 17), (20, 30, 40)):
        monkeypatch.setattr(B, "_KEPT_WORDS", words)
        monkeypatch.setattr(B, "_KEPT_PAIRS", pairs)
        monkeypatch.setattr(B, "_CHUNK", chunk)
        mine = B.Bpe(path)
        got = [mine.encode(text) for text in held]
        assert [ids.tolist() for ids in got] == want
        assert [mine.decode(ids) for ids in got] == back


def merged(merges, word):
    """Plain merging by rank, leftmost first."""
    parts = list(word)
    while True:
        found = [(merges.index(pair), i) for i, pair in enumerate(zip(parts, parts[1:])) if pair in merges]
        if not found:
            return parts
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_invented_vocabularies():
    """Small alphabets and many merges: edges, runs and tokens that merging cannot reach."""
    rng = random.Random(7)
    for _ in range(150):
        letters, merges = "ab" if rng.random() < 0.5 else "abc", []
        tokens = list(letters)
        for _ in range(rng.randint(1, 12)):
            pair = (rng.choice(tokens), rng.choice(tokens))
            if pair not in merges and pair[0] + pair[1] not in tokens:
                merges.append(pair)
                tokens.append(pair[0] + pair[1])
        vocab = {token: i for i, token in enumerate(tokens)}
        mine = B.Bpe.__new__(B.Bpe)
        mine._end, mine._merges = "", B.Merges(vocab, merges, "")
        mine._automaton = mine._make_automaton(vocab)
        library = Tokenizer(BPE(vocab=vocab, merges=merges))
        for _ in range(40):
            word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 14)))
            ids = mine.word(word)
            assert [tokens[i] for i in ids] == merged(merges, word)
            assert ids == library.encode(word).ids


def test_rows(spark):
    library = Tokenizer.from_file(vocabulary_path(B.VOCABULARY))
    rows = [(1, None), (2, ""), (None, "no id"), (3, "same Text"), (3, "same Text"), (4, "long text, 中 " * 20_000), (5, "<|endoftext|>")]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)

    def row(i, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        return i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()

    got = [tuple(r) for r in B.report(docs).collect()]
    assert sorted(map(repr, got)) == sorted(repr(row(*r)) for r in rows)
    assert B.report(docs.limit(0)).collect() == []


def test_other_ways_to_merge_are_refused(tmp_path):
    import json

    with open(vocabulary_path(FILES[1]), encoding="utf-8") as f:
        config = json.load(f)
    config["model"]["ignore_merges"] = True
    (tmp_path / "v.json").write_text(json.dumps(config))
    with pytest.raises(ValueError, match="by rank"):
        B.Bpe(str(tmp_path / "v.json"))
