"""Distinct word shingles of whole texts as 56-bit hashes.

Words are the runs of anything but ASCII white space, A-Z lowered.  A text of
fewer words than a shingle has its whole sequence as its one shingle; a text
without words has none.  Two different shingles of one pair of documents share
a hash with a chance of about ``pairs / 2^56``, below 10^-8 for texts of 20,000
words.
"""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
#: Word hashes remembered in each Python worker.
REMEMBERED = 1 << 18


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_hash = _WordHash()
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """The 64-bit hash of each word in order."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.fromiter(map(_hash.__getitem__, words), np.uint64, len(words))


def sequences(words: np.ndarray, n: int) -> np.ndarray:
    """The 64-bit hash of each run of ``n`` words, in order."""
    last = len(words) - n + 1
    if last <= 0:
        return np.empty(0, np.uint64)
    out = np.full(last, n, np.uint64) * _M1
    for i in range(n):
        out = _mix(out + words[i : i + last])
    return out


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes (uint64 below 2^56)."""
    words = word_hashes(text)
    return np.unique(sequences(words, min(n, len(words)) or n) >> np.uint64(8))
