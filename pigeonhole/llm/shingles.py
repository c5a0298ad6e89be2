"""Word and shingle hashes, computed batch by batch with numpy inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

ODD = np.random.default_rng(20).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)  # fixed multipliers
SHIFT, MIX = np.uint64(29), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """64-bit hashes of words; at most ``limit`` are remembered."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def key(self, word):
        return word

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(self.key(word))
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ values >> SHIFT) * MIX
    return values ^ values >> SHIFT


def ascii_words(text: str) -> list[bytes]:
    """A-Z lower-cased; words end at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def runs(words: np.ndarray, places: list[int]) -> np.ndarray:
    """For every start, the hash of the words at ``places`` after it."""
    n = max(len(words) - places[-1], 0)
    total = np.zeros(n, np.uint64)
    for k, p in enumerate(places):
        total += words[p:p + n] * ODD[k]
    return mixed(total + ODD[63 - len(places)])


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; fewer words count as one shingle, no words as none."""
    if not len(words):
        return words
    return np.unique(runs(words, list(range(min(k, len(words))))))
