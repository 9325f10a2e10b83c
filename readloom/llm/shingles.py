"""Word shingles of whole texts as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Odd multipliers for the places of a shingle; later places use powers of the first.
_FIRST = 0x9E3779B97F4A7C15


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash; emptied when ``limit`` words are held."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_memo: list[WordHashes] = []


def word_memo() -> WordHashes:
    """The worker's memo, kept between its tasks."""
    if not _memo:
        _memo.append(WordHashes())
    return _memo[0]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers; each salt gives another order."""
    x = x + np.uint64((salt * _FIRST + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str, lower: bool = True) -> list[bytes]:
    """Maximal runs of characters other than space and U+0009 to U+000D, A-Z lower-cased if asked."""
    raw = text.encode("utf-8", "replace")
    return (raw.translate(_LOWER) if lower else raw).split()


def hashes(of: list[bytes], memo: WordHashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, of), np.uint64, len(of))


def grams(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, in order; none if there are fewer words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, m = np.zeros(n, np.uint64), 1
    for k in range(width):
        m = m * _FIRST & 0xFFFFFFFFFFFFFFFF
        out += h[k : k + n] * np.uint64(m)
    return mix(out)


def shingle_set(text: str | None, width: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct shingles; with fewer words than ``width``, all of them as one; without words, none."""
    h = hashes(words(text), memo) if text else np.zeros(0, np.uint64)
    if not len(h):
        return h
    g = grams(h, width) if len(h) >= width else mix(grams(h, len(h)), len(h))
    g.sort()
    return g[np.concatenate([[True], g[1:] != g[:-1]])]
