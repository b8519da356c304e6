"""Hashes of many spans of characters or bytes at once, and tables by code point."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import xxhash

#: Entries of one vectorised step.
CHUNK = 1 << 18
#: Longest span of a polynomial hash. Modulo 2^64 such hashes collide by construction on strings of some 1,024 entries.
LONG = 64
PRIME = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


@lru_cache(1)
def _powers(n: int = CHUNK + LONG) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier modulo 2^64, and those of its inverse."""
    up, down = np.full(n, PRIME, np.uint64), np.full(n, pow(PRIME, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(2)
def _table(seed: int) -> np.ndarray:
    return _keys(np.arange(1 << 16, dtype=np.uint64), seed)


def _keys(codes: np.ndarray, seed: int) -> np.ndarray:
    return mix((codes.astype(np.uint64) + np.uint64(1 + (seed << 32))) * np.uint64(PRIME))


def code_point_keys(codes: np.ndarray, seed: int = 0) -> np.ndarray:
    """A random key of each code point; from a table where all are below 65,536."""
    return _table(seed)[codes] if codes.max(initial=0) < 1 << 16 else _keys(codes, seed)


@lru_cache(1)
def _folded() -> tuple[np.ndarray, np.ndarray]:
    low, kind, word = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, np.uint8), re.compile(r"[^\W_]")
    for base in range(0, 0x110000, 1 << 10):
        block = "".join(map(chr, range(base, base + (1 << 10))))
        if not word.search(block):
            continue
        for c, x in enumerate(block, base):
            if x.isalnum():
                kind[c] = 1 if x.isalpha() else 2
                if len(y := x.lower()) == 1:
                    low[c] = ord(y)
    top = int(np.flatnonzero(kind)[-1]) + 2  # the last entry stands for all that follow: no word has them
    return low[:top].copy(), kind[:top].copy()


def folded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case of each code point (if one character), and 1 for letters, 2 for other alphanumeric characters, else 0.

    The first is right for code points of a kind above 0 only.
    """
    low, kind = _folded()
    return low.take(codes, mode="clip"), kind.take(codes, mode="clip")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """64-bit hashes of spans (ascending, apart) of an array of code points, or of others with ``keys`` by entry.

    Each seed gives hashes of its own.

    The array can have any length. The kind of hash goes by the span's own length alone: up to ``LONG``
    entries a polynomial in random keys, beyond it xxh3 of the entries.
    """
    size = ends - starts
    short = size <= LONG
    if short.all():
        return _polynomial(codes, starts, ends, keys, seed)
    out = np.empty(len(starts), np.uint64)
    out[short] = _polynomial(codes, starts[short], ends[short], keys, seed)
    for k in np.flatnonzero(~short).tolist():
        out[k] = xxhash.xxh3_64_intdigest(codes[starts[k] : ends[k]].tobytes(), seed)
    return out


def _polynomial(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray | None, seed: int) -> np.ndarray:
    up, down = _powers()
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, "right")))
        low, high = int(starts[at]), int(ends[upto - 1])
        total = np.zeros(high - low + 1, np.uint64)
        part = codes[low:high]
        np.cumsum((code_point_keys(part, seed) if keys is None else keys[part]) * up[: high - low], out=total[1:])
        a, b = starts[at:upto] - low, ends[at:upto] - low
        out[at:upto] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        at = upto
    return out


def groups(texts: list[str], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters together; a longer text stands alone."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, k
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)
