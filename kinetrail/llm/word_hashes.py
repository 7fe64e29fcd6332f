"""Hashes of words and word shingles, computed on whole byte buffers."""

from __future__ import annotations

import numpy as np

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_powers = np.cumprod(np.full(1 << 12, _FACTOR, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads bits; works in place."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.full(2 * n, _FACTOR, dtype=np.uint64))
    return _powers


def word_hashes(text: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 buffer, A-Z in lower case, cut at
    space and U+0009..U+000D."""
    solid = ~_IS_SPACE[text]
    edges = np.flatnonzero(np.diff(solid.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    letters = _LOWER[text[solid]].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    return mix(np.add.reduceat(letters * _powers_to(int(lengths.max()))[place], first))


def shingle_set(text: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all k-word shingles; with fewer words the whole
    sequence is one; without words empty."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    out = np.full(n, min(len(words), k), dtype=np.uint64)
    for i in range(min(k, len(words))):
        out = mix(out * _FACTOR + words[i : i + n])
    return np.unique(out)
