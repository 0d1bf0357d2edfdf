"""BPE ids by dynamic programming over prefixes, and texts back from ids.

Merging by rank gives every prefix of a word one last token. It is a token that ends where
the prefix does, and it goes with the last token of what is before it: those two stay apart
in the merging. One automaton over the vocabulary reports all tokens that end at a place;
the first of them that passes the test of the pair is stored for the prefix, and the
back-pointers from the whole word give its ids. No merge is carried out, and the work grows
with the length of a word, however long.

Two tokens side by side stay apart if no merge joins them on the way. While merges go on by
rank, the right edge of the left token and the left edge of the right one grow by steps known
from the vocabulary; the first rank at which both edges stand there and are a merge decides.
Of equal ranks the one further left is first.

The vocabulary file says how a text is normalised and cut into words; both are done by the
library's own components, as is finding special tokens, which are ids of their own. Where the
vocabulary cuts at every white space and drops it, ids are kept from text to text for
what stands between ASCII white space, else for the words that it cuts.

NULL and empty texts have no ids. Repeated rows are encoded alike. Long texts are normalised
and cut in parts where the vocabulary drops white space, else at once. An empty table gives no
rows. Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import json
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cilode.llm.common import per_worker, slices
from cilode.llm.packing import vocabulary_path
from cilode.llm.word_ids import cuts_as_known

VOCABULARY = "word_bpe_49k.json"
# Stands for the end of a word in vocabularies that mark it; no letter of a byte.
_END = "\x00"
_NEVER = 1 << 60
# Words whose ids a worker keeps before it lets go of those not met lately, and pairs whose
# test it keeps; they bound memory only.
_KEPT_WORDS = 150_000
_KEPT_PAIRS = 1_000_000
# Pairs of tokens are kept under one number.
_PAIR = 1 << 32

_BETWEEN_SPACES = re.compile("[^\x20\x09-\x0d]+")
_SPACE = re.compile("[\x20\x09-\x0d]")
# The same cut for what is ASCII, in lower case and without white space.
_ASCII_CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
# Characters that are cut into words at a time.
_CHUNK = 1 << 17
# Settings of a model under which merging is not by rank alone.
_OTHER_MERGING = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")


class Merges:
    """The vocabulary's tokens: how each came to be, and which of them stay apart side by side."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.rank: dict[int, int] = {}  # of the merge that makes a token; none for single letters
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self._join: dict[tuple[int, int], int] = {}  # rank of the merge of two tokens
        self.kept: dict[int, bool] = {}  # answers of `apart`
        for rank, (a, b) in enumerate(pairs):
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self._join[left, right] = rank
            if made not in self.rank:
                self.rank[made], self.left[made], self.right[made] = rank, left, right

        # Tokens that merging can leave as they are: letters, and what is made of such by the merge known for it.
        self.reached = {i for token, i in vocab.items() if i not in self.rank and self._single(token, end)}
        for token in self.rank:  # in order of rank
            parts = {self.left[token], self.right[token]}
            if any(part in self.rank and self.rank[part] > self.rank[token] for part in parts):
                raise ValueError("a merge comes before one that it needs")
            if parts <= self.reached and self.first_join(self.left[token], self.right[token]) == self.rank[token]:
                self.reached.add(token)

    @staticmethod
    def _single(token: str, end: str) -> bool:
        return len(token.removesuffix(end) if len(token) > len(end) else token) == 1

    def first_join(self, a: int, b: int) -> int:
        """The rank at which merging joins tokens a and b, or parts of them, at their border.

        Both edges begin as letters. The edge that the next merge reaches first, by rank,
        becomes the longer; a merge of the two edges as they stand has to come before.
        """
        right = [a]  # from the token to its last letter
        while right[-1] in self.right:
            right.append(self.right[right[-1]])
        left = [b]
        while left[-1] in self.left:
            left.append(self.left[left[-1]])
        i, j = len(right) - 1, len(left) - 1
        while True:
            until_right = self.rank[right[i - 1]] if i else _NEVER
            until_left = self.rank[left[j - 1]] if j else _NEVER
            joined = self._join.get((right[i], left[j]), _NEVER)
            # Of equal ranks, the merge inside the left token is further left, that inside the right one is not.
            if joined < until_right and joined <= until_left:
                return joined
            if not i and not j:
                return _NEVER
            if until_right <= until_left:
                i -= 1
            else:
                j -= 1

    def apart(self, a: int, b: int) -> bool:
        """Whether tokens a and b side by side stay as they are; not if there is no a."""
        if len(self.kept) >= _KEPT_PAIRS:
            self.kept.clear()
        known = self.kept[a * _PAIR + b] = a >= 0 and self.first_join(a, b) == _NEVER
        return known


class _Kept:
    """Ids by word. When `new` is full, it takes the place of `old`, so what is met often stays."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def put(self, word: str, ids: bytes) -> bytes:
        if len(self.new) >= _KEPT_WORDS:
            self.old, self.new = self.new, {}
        self.new[word] = ids
        return ids


class Bpe:
    """Ids of texts and texts of ids, for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model = config["model"]
        if model["type"] != "BPE" or any(model.get(name) for name in _OTHER_MERGING):
            raise ValueError(f"{path} is no vocabulary that merges by rank alone")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in config["added_tokens"]):
            raise ValueError(f"{path} has added tokens that depend on what is around them")
        decoder = config.get("decoder") or {}
        if decoder and decoder["type"] != "ByteLevel":
            raise ValueError(f"{path} has a decoder that is not known here: {decoder['type']}")
        whole = Tokenizer.from_file(path)
        self._normalise = whole.normalizer.normalize_str if whole.normalizer else str
        self._cut = whole.pre_tokenizer.pre_tokenize_str
        self._between_spaces = cuts_as_known(config)
        self._special = {t["content"]: t["id"] for t in config["added_tokens"]}
        names = sorted(self._special, key=len, reverse=True)
        self._specials = re.compile("|".join(map(re.escape, names))) if names else None
        self._end = model.get("end_of_word_suffix") or ""
        self._merges = Merges(model["vocab"], model["merges"], self._end)
        self._automaton = self._make_automaton(model["vocab"])
        self._units, self._pieces = _Kept(), _Kept()
        self._by_bytes = bool(decoder)
        self._texts = self._make_texts(model["vocab"])

    def _make_automaton(self, vocab: dict[str, int]) -> ahocorasick.Automaton:
        automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if i in self._merges.reached:
                ends = self._end and len(token) > len(self._end) and token.endswith(self._end)
                letters = token.removesuffix(self._end) + _END if ends else token
                automaton.add_word(letters, (i, len(letters)))
        automaton.make_automaton()
        return automaton

    def _make_texts(self, vocab: dict[str, int]) -> dict[int, bytes]:
        """What each id is decoded to: its bytes if the vocabulary says so, else its own name."""
        if not self._by_bytes:
            named = {**vocab, **self._special}
            return {i: token.encode() for token, i in named.items()}
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        held = {i: bytes(byte[letter] for letter in token) for token, i in vocab.items()}
        return held | {i: token.encode() for token, i in self._special.items()}

    def word(self, word: str) -> list[int]:
        """Ids of one word in letters that stand for bytes: the last token of every prefix, then back."""
        letters = word + _END if self._end else word
        last, start = [-1] * (len(letters) + 1), [0] * (len(letters) + 1)
        known, apart = self._merges.kept, self._merges.apart
        # Longer tokens come first.
        for place, (token, length) in self._automaton.iter(letters):
            if last[place + 1] < 0:
                before = place + 1 - length
                if before:
                    left = last[before]
                    fits = known.get(left * _PAIR + token)
                    if not (apart(left, token) if fits is None else fits):
                        continue
                last[place + 1], start[place + 1] = token, before
        ids, end = [], len(letters)
        while end:
            if last[end] < 0:
                raise ValueError(f"the vocabulary lacks a letter of {word!r}")
            ids.append(last[end])
            end = start[end]
        return ids[::-1]

    def _piece(self, word: str) -> bytes:
        """Ids of a word, kept."""
        kept = self._pieces
        ids = kept.new.get(word)
        if ids is None:
            ids = kept.old.get(word) or array("I", self.word(word)).tobytes()
            kept.put(word, ids)
        return ids

    def _unit(self, unit: str) -> bytes:
        """Ids of what stands between white space, in a vocabulary that cuts there; kept."""
        ids = self._units.old.get(unit)
        if ids is None:
            common = unit.isascii() and unit.isprintable()  # such letters stand for themselves
            words = _ASCII_CUT.findall(unit.lower()) if common else self._words(unit)
            ids = b"".join([self._piece(word) for word in words])
        return self._units.put(unit, ids)

    def _words(self, text: str) -> list[str]:
        """Words of a text by the vocabulary's normaliser and cut, in letters that stand for bytes."""
        return [word for word, _ in self._cut(self._normalise(text))]

    def _plain(self, text: str) -> list[bytes]:
        """Ids of a text without special tokens, in parts."""
        if not self._between_spaces:
            return [self._piece(word) for word in self._words(text)]
        parts, make, at = [], self._unit, 0
        while at < len(text):
            kept = self._units.new.get
            cut = _SPACE.search(text, at + _CHUNK)
            end = cut.start() if cut else len(text)
            parts.append(b"".join([kept(unit) or make(unit) for unit in _BETWEEN_SPACES.findall(text, at, end)]))
            at = end
        return parts

    def encode(self, text: str) -> np.ndarray:
        parts, at = [], 0
        for match in self._specials.finditer(text) if self._specials else ():
            parts += self._plain(text[at : match.start()])
            parts.append(array("I", [self._special[match[0]]]).tobytes())
            at = match.end()
        parts += self._plain(text[at:] if at else text)
        return np.frombuffer(b"".join(parts), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special ones included: their bytes one after the other, what is no UTF-8
        replaced, or where the vocabulary has no decoder their names with spaces between."""
        held = self._texts
        names = [held[i] for i in ids.tolist() if i in held]
        return (b"" if self._by_bytes else b" ").join(names).decode("utf-8", "replace")


def bpe(vocabulary: str) -> Bpe:
    """One per worker process, so that words are kept from task to task."""
    return per_worker(("bpe", vocabulary), lambda: Bpe(vocabulary_path(vocabulary)))


def _ids(vocabulary: str):
    def run(batches):
        made = bpe(vocabulary)
        for batch in slices(batches):
            held = [made.encode(text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(ids) for ids in held], pa.int64()),
                    pa.array([ids.astype("<u4").tobytes() for ids in held], pa.binary()),
                ],
                names=["doc_id", "n_tokens", "ids"],
            )

    return run


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian, 32 bits each): one row per row of `docs`."""
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return texts.mapInArrow(_ids(vocabulary), "doc_id long, n_tokens long, ids binary")


def _texts(vocabulary: str):
    def run(batches):
        made = bpe(vocabulary)
        for batch in slices(batches):
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            texts = [made.decode(np.frombuffer(held, "<u4")) for held in ids]
            yield batch.append_column("decoded", pa.array(texts, pa.string()))

    return run


def decoded(ids: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows with the texts of their `ids`, as `decoded`."""
    return ids.mapInArrow(_texts(vocabulary), ids.withColumn("decoded", F.lit("")).schema)


def report(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return decoded(encoded(docs, vocabulary), vocabulary).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
