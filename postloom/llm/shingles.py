"""Word shingles as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import Memo

_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Distinct w-word shingles of a text: ASCII letters lowered, words parted by ASCII white space.

    A text of fewer than w words is one shingle; one without words has none. Words are hashed by XXH3 and kept in a bounded
    memo, shingles mix their words' hashes by position; two different shingles share a value with probability 2^-64."""

    def __init__(self, width: int):
        self.width = width
        self.word = Memo(xxhash.xxh3_64_intdigest, 300_000)

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct shingle hashes (uint64)."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.word.__getitem__, words), np.uint64, len(words))
        w = min(self.width, len(words))
        with np.errstate(over="ignore"):
            total = np.full(len(h) - w + 1, w, np.uint64)
            for k in range(w):
                total = _mix(total + h[k : len(h) - w + 1 + k] * _MULT[k % len(_MULT)] + np.uint64(k))
        return np.unique(total)
