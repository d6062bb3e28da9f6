"""Word shingles of whole texts as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from tidewright.llm.worker import claim

_CACHE = 250_000
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word bytes -> 64-bit hash."""

    def __init__(self):
        super().__init__()
        claim("shingles")

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) < 40:
            self[word] = h
        return h

    def of(self, text: bytes) -> np.ndarray:
        """Hashes of a text's words: A-Z lower-cased, split at ASCII white space."""
        ws = text.lower().split()  # of bytes: ASCII only
        if len(self) > _CACHE:
            self.clear()
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; fewer words are one shingle, none are none."""
    if not len(words):
        return words
    k = min(n, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out += words[i : len(words) - k + 1 + i] * _MUL[i]
    out = np.sort(mix(out + np.uint64(k)))
    return out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) > 1 else out


def identity(s: np.ndarray) -> int:
    """A signed 64-bit name of the set."""
    return int(np.frombuffer(xxhash.xxh64_digest(s.tobytes(), 77), ">i8")[0])
