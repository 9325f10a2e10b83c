"""Ungapped alignments of many reads at once, as NumPy arrays: one comparison of byte matrices a shift."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

N = ord("N")


def matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of bytes, padded with 0, and their lengths."""
    raw = [t.encode("latin-1", "replace") for t in texts]
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    out = np.zeros((len(raw), int(lens.max(initial=0))), np.uint8)
    out[np.arange(out.shape[1]) < lens[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
    return out, lens


@dataclass
class Alignments:
    """For each read the best shift, its overlap, matches and ambiguous bases; overlap is 0 where there is none."""

    shift: np.ndarray
    overlap: np.ndarray
    matches: np.ndarray
    ambiguous: np.ndarray

    @property
    def score(self) -> np.ndarray:
        return 2 * self.matches - self.overlap + self.ambiguous

    @property
    def mismatches(self) -> np.ndarray:
        return self.overlap - self.matches - self.ambiguous


def error_probabilities(quals: np.ndarray) -> np.ndarray:
    """Of Phred + 33 bytes."""
    return np.power(10.0, -(quals.astype(np.float64) - 33) / 10)


def align(reads: np.ndarray, lens: np.ndarray, other: np.ndarray, other_lens: np.ndarray, lo: np.ndarray, hi: np.ndarray, quals: np.ndarray | None = None, by_score: bool = False) -> Alignments:
    """The best of all shifts from lo to hi of ``other`` (one row for all reads, or one each) against each read.

    A base matches if it is equal and no N; N on either side is ambiguous, no error. Best is the least share of errors; with
    ``by_score`` the highest score instead, in which ambiguous bases count 0. Of equals the longest overlap wins, then the first shift. With ``quals``, the
    whole part of the error probabilities summed over mismatches counts as ambiguous too.
    """
    n = len(lens)
    zeros = lambda: np.zeros(n, np.int64)
    best = Alignments(zeros(), zeros(), zeros(), zeros())
    rank = np.full(n, np.inf)
    wrong = error_probabilities(quals) if quals is not None else None
    for s in range(int(lo.min(initial=0)), int(hi.max(initial=-1)) + 1):
        start, first = max(s, 0), max(-s, 0)
        overlap = np.minimum(lens - start, other_lens - first)
        width = min(reads.shape[1] - start, other.shape[1] - first)
        use = np.flatnonzero((lo <= s) & (s <= hi) & (overlap > 0))
        if not len(use) or width <= 0:
            continue
        x = reads[use, start : start + width]
        y = other[:, first : first + width] if len(other) == 1 else other[use, first : first + width]
        both = (x != 0) & (y != 0)
        unknown = both & ((x == N) | (y == N))
        same = both & (x == y) & ~unknown
        o, good, amb = overlap[use], same.sum(axis=1), unknown.sum(axis=1)
        if wrong is not None:
            amb = amb + np.floor((wrong[use, start : start + width] * (both & ~unknown & ~same)).sum(axis=1)).astype(np.int64)
        key = -(2.0 * good + amb - o) if by_score else (o - good - amb) / o
        better = (key < rank[use]) | ((key == rank[use]) & (o > best.overlap[use]))
        at = use[better]
        rank[at], best.shift[at], best.overlap[at], best.matches[at], best.ambiguous[at] = key[better], s, o[better], good[better], amb[better]
    return best


def allowed(overlap: np.ndarray, rate: float, errors: int | None, non_linear: bool) -> np.ndarray:
    """Errors allowed in an overlap: a fixed number, or a share of it; ``non_linear`` allows none in short overlaps and one in middling ones."""
    if errors is not None or not rate:
        return np.full(len(overlap), errors or 0)
    n = np.floor(rate * overlap)
    return np.where(overlap < 6, 0, np.where(overlap < 10, np.minimum(n, 1), n)) if non_linear else n
