"""Word shingles of whole texts as sets of 64-bit hashes.

Words are runs of other bytes than ASCII white space, A-Z lower-cased. All words of many texts are
hashed at once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from spanloom.llm.hashing import CHUNK, mix, span_hashes

_MULTIPLIER = 0xC2B2AE3D27D4EB4F


@lru_cache(1)
def _bytes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By byte: a random key, its lower case, and whether it is white space."""
    low, space = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
    low[65:91] = low[97:123]
    space[[32, 9, 10, 11, 12, 13]] = True
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER)), low, space


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word."""
    keys, low, space = _bytes()
    word = np.concatenate([[False], ~space[raw], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], span_hashes(low[raw], edge[::2], edge[1::2], keys)


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """The hash of every word of each text, in order."""
    out: list = [None] * len(texts)
    raws = [t.encode() for t in texts]
    at = 0
    while at < len(raws):
        end, size = at + 1, len(raws[at])
        while end < len(raws) and size + len(raws[end]) < CHUNK:
            size += len(raws[end]) + 1
            end += 1
        start, h = _words(np.frombuffer(b"\n".join(raws[at:end]), np.uint8))
        edge = np.searchsorted(start, np.cumsum([0] + [len(r) + 1 for r in raws[at:end]]))
        for k in range(at, end):
            out[k] = h[edge[k - at] : edge[k - at + 1]]
        at = end
    return out


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each place of a shingle; fewer words than ``size`` are one shingle; none, none."""
    n = len(words)
    if not n:
        return words
    k = min(size, n)
    total, p = np.zeros(n - k + 1, np.uint64), 1
    for j in range(k):
        total += words[j : n - k + 1 + j] * np.uint64(p)
        p = p * _MULTIPLIER % (1 << 64)
    return mix(total + np.uint64(k))


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    return [np.unique(shingle_hashes(w, size)) for w in word_hashes(texts)]
