"""Hashed character features of many words at once, in numpy."""

from __future__ import annotations

import numpy as np

from clickstack.llm.base import ship_by_value

#: Multipliers of the polynomial hash, by position in the hashed run of bytes.
POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(256)], np.uint64)


def _bucket(h: np.ndarray, salt: int, buckets: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


class Words:
    """Words as one run of bytes."""

    def __init__(self, words: list[bytes]):
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)

    def _runs(self, at: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for j in range(n):
            h += self.bytes[at + j] * POWERS[j]
        return h

    def whole(self, salt: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(word number, bucket) of each whole word."""
        h = np.zeros(len(self.sizes), np.uint64)
        full = np.flatnonzero(self.sizes)
        if len(full):
            place = np.arange(len(self.bytes)) - np.repeat(self.starts, self.sizes)
            h[full] = np.add.reduceat(self.bytes * POWERS[place % 256] * (place // 256 * 2 + 1).astype(np.uint64), self.starts[full])
        return np.arange(len(self.sizes)), _bucket(h, salt, buckets)

    def prefixes(self, n: int, salt: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(word number, bucket) of the first ``n`` bytes of the words that have as many."""
        long = np.flatnonzero(self.sizes >= n)
        return long, _bucket(self._runs(self.starts[long], n), salt, buckets)

    def suffixes(self, n: int, salt: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        long = np.flatnonzero(self.sizes >= n)
        return long, _bucket(self._runs(self.starts[long] + self.sizes[long] - n, n), salt, buckets)

    def ngrams(self, n: int, salt: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(word number, bucket) of every run of ``n`` bytes inside a word."""
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        at = np.arange(len(owner))
        inside = at + n <= (self.starts + self.sizes)[owner] if len(owner) else np.zeros(0, bool)
        return owner[inside], _bucket(self._runs(at[inside], n), salt, buckets)


def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """All (word number, bucket) pairs, by word number."""
    owner, bucket = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(owner, kind="stable")
    return owner[order], bucket[order]


ship_by_value(__name__)
