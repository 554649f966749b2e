"""Word shingles of a text as sets of 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_CACHE_WORDS = 500_000


class WordHashes(dict):
    """Hash of each word met, kept while it has under _CACHE_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words(text: str | None) -> list[bytes]:
    r"""UTF-8 words ``[^\x20\x09-\x0D]+`` with A-Z in lower case: both are what ``bytes`` methods do."""
    return (text or "").encode("utf-8", "replace").lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; with fewer words the whole sequence is one."""
    ws = words(text)
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, ws), np.uint64, len(ws))
    width = min(size, len(h))
    found = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        found = mix(found * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - width + 1 + j])
    return np.unique(found)
