"""Word shingles of whole texts as 64-bit hashes, with numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .common import code_points, mix64

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
STEP = np.uint64(0xD1B54A32D192ED03)


@lru_cache(maxsize=1)
def word_table() -> np.ndarray:
    """Whether a code point is part of a word: letters, digits and marks."""
    return np.array([chr(c).isalnum() for c in range(0x110000)])


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of lower-case texts, and where each text's words begin."""
    codes, starts = code_points([t.lower() + "\n" for t in texts])
    word = word_table()[codes]
    edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=np.int8(0)))
    begin, end = edge[0::2], edge[1::2]  # every text ends in a newline, so words end before that
    power = _powers(BASE, len(codes) + 1)
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes.astype(np.uint64) * power[:-1], out=total[1:])
    back = _powers(INVERSE, len(codes) + 1)
    h = mix64((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64))
    return h, np.searchsorted(begin, starts)


def shingle_sets(texts: list[str], size: int = 5, counts: bool = False) -> list:
    """Per text the sorted distinct shingle hashes (with counts if asked). Fewer words than ``size`` make one shingle of all."""
    words, at = word_hashes(texts)
    rolled = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
    for k in range(size):
        rolled = rolled * STEP + words[k : k + len(rolled)]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= size:
            own = rolled[a : b - size + 1]
        elif b > a:
            h = np.zeros(1, dtype=np.uint64)
            for w in words[a:b]:
                h = h * STEP + w
            own = mix64(h + np.uint64(b - a))
        else:
            own = rolled[:0]
        out.append(np.unique(own, return_counts=True) if counts else np.unique(own))
    return out
