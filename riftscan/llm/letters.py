"""Lower-case letters of many texts at once, as arrays of code points.

Everything that is not a letter counts as a gap (0); runs of gaps are one, and
each text begins and ends with a gap.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from riftscan.llm.shingles import BASE, INVERSE, mix, powers, stream

_U = np.uint64


@lru_cache(maxsize=1)
def lower_letters() -> np.ndarray:
    """The lower-case form of each code point that is a letter, else 0."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and gaps of all texts, and where each text's part begins (and the last ends)."""
    codes = lower_letters()[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)]
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]  # code points before each text
    m = len(offsets) - 1
    codes = np.insert(codes, np.repeat(heads, 2)[1:-1], 0) if m else codes
    begin = heads[:-1] + 2 * np.arange(m)  # the gap that opens text k
    opens = np.zeros(len(codes), dtype=bool)
    opens[begin] = True
    keep = (codes != 0) | opens
    keep[1:] |= codes[:-1] != 0
    at = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], at[np.concatenate([begin, [len(codes)]])]


def grams(codes: np.ndarray, heads: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` letters or gaps inside a text, and the text that it is in."""
    place = stream(41, n) | _U(1)
    m = max(0, len(codes) - n + 1)
    out = np.zeros(m, dtype=_U)
    for k in range(n):
        out += codes[k : k + m].astype(_U) * place[k]
    text = np.repeat(np.arange(len(heads) - 1), np.diff(heads))
    inside = text[:m] == text[n - 1 : n - 1 + m]
    return mix(out[inside]), text[:m][inside]


def word_features(codes: np.ndarray, heads: np.ndarray, prefixes: tuple[int, ...] = (4, 5)) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct words and word beginnings, and the text of each."""
    letter = codes != 0
    start = np.flatnonzero(letter & np.concatenate([[True], ~letter[:-1]]))
    stop = np.flatnonzero(letter & np.concatenate([~letter[1:], [True]])) + 1
    if not len(start):
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
    size = stop - start
    text = np.searchsorted(heads, start, side="right") - 1
    n = len(codes)
    sums = np.concatenate([np.zeros(1, dtype=_U), np.cumsum(mix(codes.astype(_U) + _U(1)) * powers(BASE, n), dtype=_U)])
    back = powers(INVERSE, n + 1)
    hashes, owners = [], []
    for k in prefixes:
        some = np.flatnonzero(size >= k)
        hashes.append(mix((sums[start[some] + k] - sums[start[some]]) * back[start[some]] + _U(k)))
        owners.append(text[some])
    hashes.append(mix((sums[stop] - sums[start]) * back[start] + size.astype(_U) * _U(0x9E3779B97F4A7C15)))
    owners.append(text)
    h, t = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])])
    return h[new], t[new]
