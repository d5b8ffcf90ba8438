"""Hashed word shingles in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from corpusloom.llm.memory import held

REMEMBERED_WORDS = 200_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shifts and odd multipliers), wrapping."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0x9FB21C651E98DF25)
    return x ^ (x >> U(32))


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def words(self, text: bytes) -> np.ndarray:
        """Hashes of the words of a UTF-8 text: A-Z lower-cased, split at ASCII white space."""
        found = text.lower().split()
        return np.fromiter(map(self.__getitem__, found), dtype=U, count=len(found))


def word_hashes() -> WordHashes:
    """One memory of words for all tasks that a Python worker runs."""
    return held("word hashes", WordHashes)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size``-word shingles; fewer words make one shingle; no words, none."""
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    h = mix(words[: n - width + 1] + U(width))
    for k in range(1, width):
        h = mix(h + words[k : n - width + 1 + k])
    return np.unique(h)
