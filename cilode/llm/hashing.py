"""Hashes of words and word n-grams of one text, in numpy; used inside tasks."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**63, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_CHUNK = 1 << 20
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        held = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunks(data: bytes):
    """Slices of about _CHUNK bytes that end where a word ends."""
    start = 0
    while start < len(data):
        end = start + _CHUNK
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[start:end]
        start = end


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash per word between ASCII white space, in order."""
    parts = []
    for chunk in _chunks(data):
        codes = np.frombuffer(chunk, np.uint8)
        edges = np.diff(np.concatenate(([1], _SPACE[codes], [1])).astype(np.int8))
        starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_LETTER[codes] * _powers(_BASE, len(codes)), out=sums[1:])
        parts.append(mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(codes) + 1)[starts]))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingles(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words; of all words if there are fewer."""
    held = word_hashes(data)
    if not len(held):
        return held
    width = min(width, len(held))
    runs = np.full(len(held) - width + 1, width, np.uint64)
    for k in range(width):
        runs = runs * np.uint64(0xD6E8FEB86659FD93) + held[k : len(held) - width + 1 + k]
    return np.unique(mix(runs))


def set_hash(members: np.ndarray) -> np.ndarray:
    """Running sums that tell sets apart: the hash of members[i:j] is sums[j] - sums[i]."""
    sums = np.zeros(len(members) + 1, np.uint64)
    np.cumsum(mix(members ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    return sums
