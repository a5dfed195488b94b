"""Word shingle sets as sorted 64-bit hashes, made inside tasks with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Words whose hash a worker keeps; the table starts anew when it is full, which changes no result.
CACHE_WORDS = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Distinct shingles of ``size`` words, A-Z in lower case; all words as one shingle where there are fewer; sorted."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    acc = np.full(n, min(size, len(h)), np.uint64)
    for j in range(min(size, len(h))):
        acc = mix((acc + _STEP) ^ h[j : j + n])
    return np.unique(acc)


def signature(shingles: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The least of each of ``len(mul)`` multiply-shift hashes over the set, as unsigned 32-bit numbers."""
    least = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):  # long texts in slices
        np.minimum(least, (mul[:, None] * shingles[None, at : at + 4096] + add[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)
