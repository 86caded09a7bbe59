"""Words of many texts at once, as 64-bit hashes in numpy arrays.

A word is a maximal run of letters or digits, compared in lower case.  A batch of
texts is joined into one code-point array; word bounds and hashes come from whole-array
operations, so the cost per text is a few array passes rather than a Python loop.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

_U = np.uint64


@cache
def _alnum() -> np.ndarray:
    """Whether a code point is a letter or digit; all code points above the table aren't."""
    table = np.zeros(0x110000, dtype=bool)
    table[:0x33480] = [chr(i).isalnum() for i in range(0x33480)]
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finaliser of a well-known hash)."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


#: Base of the polynomial hash of a word, and its inverse modulo 2 ** 64.
BASE = 0x100000001B3
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _up_to(n: int) -> list[np.ndarray]:
    """Powers of the base, and of its inverse, n of each at least; kept for the process."""
    if len(_powers[0]) < n:
        for i, b in enumerate((BASE, pow(BASE, -1, 2**64))):
            p = np.full(max(n, 1 << 20), b, _U)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=_U)
    return _powers


@dataclass
class Words:
    """Word ``i`` of the batch: ``hash[i]``, code points ``start[i]:end[i]`` of its lower-cased text, of which ``lead[i]`` is the first.

    The words of text ``d`` are ``first[d]:first[d + 1]``; ``doc`` has each word's text, ``closes`` whether a line ends after it.
    """

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    closes: np.ndarray
    lead: np.ndarray

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``k`` words within one text, and the run's first word."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        h = np.zeros(n, _U)
        for i in range(k):
            h = h * _U(0x9E3779B97F4A7C15) + self.hash[i : i + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return mix(h[at]), at


def words_of(texts: list[str | None]) -> Words:
    """Words of the texts; None counts as an empty text."""
    lower = [t.lower() if t else "" for t in texts]
    points = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(np.array([len(t) + 1 for t in lower], dtype=np.int64)) if lower else np.zeros(0, np.int64)
    is_word = _alnum()[points]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], is_word, [False])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    doc = np.searchsorted(ends, start, side="right")
    first = np.searchsorted(start, np.concatenate((ends - [len(t) + 1 for t in lower], ends[-1:]))) if lower else np.zeros(1, np.int64)
    if not len(start):
        return Words(np.zeros(0, _U), doc, start, end, first, np.zeros(0, bool), np.zeros(0, np.uint32))
    # A word's hash is a polynomial in its letters: a difference of sums over the batch, moved to the word's begin.
    power, inverse = _up_to(len(points))
    sums = np.zeros(len(points) + 1, _U)
    np.cumsum((points.astype(_U) + _U(0x9E3779B9)) * power[: len(points)], out=sums[1:])
    hashed = mix((sums[end] - sums[start]) * inverse[start] * _U(0x2545F4914F6CDD1D) + (end - start).astype(_U))
    begin = (ends - [len(t) + 1 for t in lower])[doc]
    return Words(hashed, doc, start - begin, end - begin, first, points[end] == 10, points[start])


def blocks(texts: list, most: int = 1_000_000):
    """(from, to) bounds of runs of texts of about ``most`` characters, for bounded memory."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
