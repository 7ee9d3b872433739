"""Word shingles and MinHash values of many texts at once, as numpy arrays.

A slice holds the bytes of many texts; words, shingles and minima are found
for all of them with a few array operations. Words are runs of bytes other
than white space. Hashes are 64 bits: a polynomial over table values of the
bytes, by differences of one running sum, then mixed.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
_U = np.uint64
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


TABLE = stream(11, 256)
PLACE = stream(12, WORDS) | _U(1)
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, dtype=_U)
        step[0] = 1
        have = _powers[base] = np.cumprod(step, dtype=_U)
        if n > 1 << 23:  # a very long text: don't keep its powers
            del _powers[base]
    return have[:n]


def running(data: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hash`` gets the hash of any span."""
    out = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(TABLE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mix((sums[stop] - sums[start]) * powers(INVERSE, len(sums))[start])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the number of words of each text."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    np.logical_not(BLANK[data], out=inside[1:-1])
    begin = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]  # a word does not go on into the next text
    begin[edges] = inside[1:-1][edges]
    end[edges - 1] = inside[1:-1][edges - 1]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    counts = np.diff(np.searchsorted(start, offsets))
    return span_hash(running(data), start, stop), counts


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle, and the number of shingles of each text.

    A text of fewer than five words, but not none, is one shingle.
    """
    hashes, counts = words(data, offsets)
    n = len(hashes)
    padded = np.concatenate([hashes, np.zeros(WORDS - 1, dtype=_U)])
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    out = np.zeros(n, dtype=_U)
    for k in range(WORDS):
        out += padded[k : k + n] * PLACE[k]
    left = np.repeat(first + counts, counts) - np.arange(n)  # words from here to the end of the text
    keep = left >= WORDS
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    for k in short:
        at, m = first[k], counts[k]
        with np.errstate(over="ignore"):
            out[at] = (hashes[at : at + m] * PLACE[:m]).sum(dtype=_U) + _U(m)
        keep[at] = True
    return mix(out[keep]), np.where(counts >= WORDS, counts - WORDS + 1, (counts > 0).astype(counts.dtype))


def minima(values: np.ndarray, counts: np.ndarray, n_hashes: int, seed: int = 13) -> np.ndarray:
    """MinHash values, a row for each text; a text without shingles has the largest value throughout."""
    a, b = stream(seed, n_hashes) | _U(1), stream(seed + 1, n_hashes)
    out = np.full((len(counts), n_hashes), np.iinfo(np.uint64).max, dtype=_U)
    some = counts > 0
    if not some.any():
        return out
    starts = (np.cumsum(counts) - counts)[some]
    scratch = np.empty_like(values)
    for k in range(n_hashes):
        np.multiply(values, a[k], out=scratch)
        np.add(scratch, b[k], out=scratch)
        out[some, k] = np.minimum.reduceat(scratch, starts)
    return out
