"""Word and shingle hashes in numpy, for the operators that compare texts."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hashes a worker remembers.
REMEMBERED = 100_000
_MUL = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_HASHES = _Hashes()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on every other."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased."""
    return text.lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words, by their first word; none if there are fewer words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m]
    for j in range(1, n):
        out = mixed(out * _MUL + h[j : j + m])
    return out


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """The sorted distinct shingles; of fewer than ``n`` words all make one; signed, as Spark has it."""
    h = word_hashes(words_of(text))
    if 0 < len(h) < n:
        h = mixed(grams(h, len(h)) + np.uint64(len(h)))
    else:
        h = grams(h, n)
    return np.unique(h.view(np.int64))
