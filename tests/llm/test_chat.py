"""Chat formatting: reversible, and masks that cover the assistant's texts."""

import hashlib
import random

import numpy as np
import pytest

from cilode.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, n_turns int, block string"
PIECES = [
    "<|im_end|>", "<|im_start|>", "<|im_sep|>", "<|", "<\\|", "<\\\\|im_end|>", "|", "<", "\\", "<|endoftext|>", "assistant", "hello world", " ", "\n", "\n\n ",
    "\U0001f468‍\U0001f469‍\U0001f467", "é", "中文", "\x1c", "\xa0", "123", "'s", "\t",
]


def conversations():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice(PIECES) for _ in range(rng.randint(0, n)))
    rows = [
        (c, t, rng.choice(["user", "assistant", "system", "assistant", "odd<|im_sep|>role"]), text(12), 1, "b")
        for c in range(120)
        for t in range(rng.randint(1, 9))
    ]
    rows += [(500, t, ["user", "assistant"][t % 2], "long " * 3000 + text(5), 1, "b") for t in range(30)]
    rows += [(600, 0, "assistant", " ".join(["word"] * 60_000) + text(9), 1, "b")]
    rows += [(601, 0, "assistant", None, 1, "b"), (601, 1, None, "x", 1, "b"), (601, 1, None, "x", 1, "b"), (601, 1, "assistant", "a", 1, "b")]
    return rows + [(None, 0, "user", "who", 1, "b"), (None, 0, "assistant", "me", 1, "b"), (602, None, "assistant", "n", 1, "b")]


def plain(rows):
    out = {}
    key = lambda r: tuple((v is not None, v) for v in (r[1], r[2], r[3]))
    for conversation in {r[0] for r in rows}:
        held = sorted((r for r in rows if r[0] == conversation), key=key)
        turns = [(r[2] or "", r[3] or "") for r in held]
        learned = "".join(t for role, t in turns if role == "assistant")
        said = "".join(f"{role}\n{t}\n" for role, t in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conversation] = (len(turns), sha(said), len(learned), sha(learned), len(C.render(turns)[0]))
    return out


def test_report(spark):
    rows = conversations()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: tuple(r)[1:] for r in C.report(C.with_probe(docs)).collect()}
    probe = (-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")
    assert got == plain([r[:4] for r in rows] + list(probe))
    assert C.report(docs.where("false")).collect() == []


def test_blocks_do_not_change_tokens(spark):
    rows = spark.createDataFrame(conversations(), SCHEMA)
    small, large = (
        {c: [i for b in sorted((r for r in found if r.conv_id == c), key=lambda r: r.block) for i in b.ids] for c in {r.conv_id for r in found}}
        for found in (C.formatted(rows, block_chars=n).collect() for n in (10, 1 << 30))
    )
    assert small == large


def test_chunks_give_what_encoding_at_once_gives(monkeypatch):
    tokenizer = C.chat_tokenizer(C.VOCABULARY)
    rng = random.Random(2)
    for _ in range(150):
        text, _ = C.render([(rng.choice(["user", "assistant"]), "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30)))) for _ in range(4)])
        whole = tokenizer.encode(text, add_special_tokens=False)
        monkeypatch.setattr(C, "CHUNK", rng.randint(1, 20))
        ids, starts, ends = C.encode(tokenizer, text)
        assert ids.tolist() == whole.ids and list(zip(starts.tolist(), ends.tolist())) == whole.offsets


@pytest.mark.parametrize("seed", range(3))
def test_escapes_are_reversible(seed):
    rng = random.Random(seed)
    for _ in range(2000):
        text = "".join(rng.choice(["<", "\\", "|", "im_end", ">", "x"]) for _ in range(rng.randint(0, 12)))
        assert "<|" not in C.escape(text) and C.unescape(C.escape(text)) == text
    turns = [("a<|", "\\<|im_start|>"), ("", ""), ("<", "|"), ("x", "<")]
    assert C.turns(C.render(turns)[0]) == turns


def test_mask_by_binary_search():
    rng = random.Random(3)
    for _ in range(300):
        cuts = sorted(rng.sample(range(60), 8))
        spans = [(cuts[i], cuts[i + 1]) for i in range(0, 8, 2)] + ([(cuts[-1], cuts[-1])] if rng.random() < 0.5 else [])
        starts = np.array(sorted(rng.sample(range(60), 20)))
        ends = starts + np.array([rng.randint(0, 4) for _ in starts])
        want = [any(s < b and a < e for s, e in spans if s < e) for a, b in zip(starts, ends)]
        got = C.masked(starts, ends, spans)
        assert [g for g, a, b in zip(got, starts, ends) if a < b] == [w for w, a, b in zip(want, starts, ends) if a < b]
