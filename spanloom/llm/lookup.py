"""Lookup of 64-bit hashes in sorted arrays."""

from __future__ import annotations

import numpy as np


class Sorted:
    """A sorted hash array; a table of leading bits says where to begin."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(np.unique(keys), np.uint64(2**64 - 1))
        self.shift = np.uint64(64 - max(4, int(len(self.keys)).bit_length() + 1))
        self.begin = np.searchsorted(self.keys, np.arange(1 << int(64 - self.shift), dtype=np.uint64) << self.shift).astype(np.int32)

    def __len__(self) -> int:
        return len(self.keys) - 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1."""
        at = self.begin[h >> self.shift]
        on = np.flatnonzero(self.keys[at] < h)
        while len(on):
            at[on] += 1
            on = on[self.keys[at[on]] < h[on]]
        return np.where(self.keys[at] == h, at, -1)
