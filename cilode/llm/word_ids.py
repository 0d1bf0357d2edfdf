"""Token ids of texts, with the ids of words kept; used inside tasks.

A vocabulary that cuts a text at white space and into words before it merges anything lets ids
be kept word by word. If it is the one whose cut is known here, texts of common characters
are cut here and their words go to the model directly; all others go through the whole
tokenizer, in parts that end at a space. With any other vocabulary a text goes through the
whole tokenizer at once.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
from tokenizers import Tokenizer

from cilode.llm.common import per_worker

# Characters whose normal form and class are the same everywhere: ASCII and Latin-1 letters.
_COMMON = re.compile("[\t\n\r\x20-\x7e¡«»¿À-ÖØ-öø-ÿ]*")
# The vocabulary's own way to cut a text, for those characters in lower case.
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
# What most often ends a word.
_MARKS = ".,;:!?"
# Characters that are cut into words at a time.
_CHUNK = 1 << 17
# Words kept at a time, some 100 MB. It bounds memory only.
_KEPT = 500_000


def _byte_letters() -> list[str]:
    """The letters that stand for the 256 bytes in byte-level vocabularies: a printable
    byte stands for itself, the others for what follows the first 256 code points."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


# The normaliser and the cut of the vocabulary that is known here.
KNOWN_NORMALISER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
KNOWN_CUT = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def cuts_as_known(config: dict) -> bool:
    """Whether a vocabulary file normalises and cuts texts as the one known here."""
    return (config.get("normalizer"), config.get("pre_tokenizer")) == (KNOWN_NORMALISER, KNOWN_CUT)


class WordIds:
    def __init__(self, path: str):
        self._whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        special = [t for t in config["added_tokens"] if not t["content"].startswith("<|")]
        self._known = cuts_as_known(config) and not special
        self._model = self._whole.model
        self._letters = _byte_letters()
        self._kept: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """Ids of what stands between white space, or of a piece of it."""
        ids = self._kept.get(word)
        if ids is None:
            if word.isalpha():
                pieces = [word]
            elif word[-1] in _MARKS and word[:-1].isalpha():
                pieces = [word[:-1], word[-1]]
            else:
                pieces = _PIECE.findall(word)
            if len(pieces) == 1:
                letters = word if word.isascii() else "".join([self._letters[b] for b in word.encode()])
                ids = array("I", [t.id for t in self._model.tokenize(letters)]).tobytes()
            else:
                ids = b"".join([self._word(piece) for piece in pieces])
            if len(self._kept) >= _KEPT:
                self._kept.clear()
            self._kept[word] = ids
        return ids

    def _common(self, unit: str) -> bytes:
        kept, make = self._kept.get, self._word
        return b"".join([kept(word) or make(word) for word in unit.lower().split()])

    def _rare(self, unit: str) -> bytes:
        return array("I", self._whole.encode(unit, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> np.ndarray:
        """What the tokenizer gives for a text without adding special tokens, part after part; parts end
        at a space where that is known to be the same."""
        if not self._known:
            return np.frombuffer(self._rare(text), np.uint32)
        rare = "<|" in text or _COMMON.fullmatch(text) is None
        made, parts, start = self._rare if rare else self._common, [], 0
        while start < len(text):
            end = text.find(" ", start + _CHUNK)
            end = len(text) if end < 0 else end
            parts.append(made(text[start:end]))
            start = end
        return np.frombuffer(b"".join(parts), np.uint32)


def word_ids(path: str) -> WordIds:
    """One per worker process, so that words are kept from task to task."""
    return per_worker(("word_ids", path), lambda: WordIds(path))
