"""Word arrays and 64-bit word and shingle hashes inside Arrow tasks.

Words are taken from the UTF-8 bytes: ``bytes.split()`` cuts at the six ASCII white-space characters, which is the
word pattern ``[^\\x20\\x09-\\x0D]+``, and ``bytes.lower()`` changes A-Z only.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: A cache holds so many words of so many bytes at most, about 30 MB.
KEEP_WORDS, KEEP_BYTES = 200_000, 64


class WordHashes(dict):
    """Word bytes -> xxh3 hash.  Forgets everything when it is full and keeps no long word: memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= KEEP_BYTES:
            if len(self) >= KEEP_WORDS:
                self.clear()
            self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def _multipliers(k: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(b"multiplier %d" % i) | 1 for i in range(k)], dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(28))


def window_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of ``k`` codes; empty if there are fewer."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for i, m in enumerate(_multipliers(k)):
        h += codes[i : i + n] * m
    return _mixed(h)


def shingle_set(codes: np.ndarray, k: int = 3) -> np.ndarray:
    """The distinct k-word shingles, sorted.  Fewer words: the whole sequence as one.  No word: empty."""
    if 0 < len(codes) < k:
        return window_hashes(codes, len(codes)) ^ np.uint64(len(codes))
    return np.unique(window_hashes(codes, k))
