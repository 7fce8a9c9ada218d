"""A compressed FM-index over byte symbols: wavelet matrix, rank directory, backward search.

Built for matches up to `depth` symbols: suffixes are sorted by their first
`depth` symbols, which is all that backward search for such patterns needs.
Queries run in lock-step as numpy arrays, so many patterns cost few passes.

Defined cases: a text of separators alone has no pattern in it; equal suffixes of `depth`
symbols are in text order; without queries nothing is searched.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def sort_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order by the first `depth` symbols (prefix doubling from packed runs of eight)."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    packed = np.zeros(n, np.uint64)
    for j in range(8):
        packed = (packed << _U(8)) | padded[j : j + n]
    rank = np.unique(packed, return_inverse=True)[1].astype(np.int64)
    have = 8
    while have < depth:
        after = np.zeros(n, np.int64)
        after[: max(n - have, 0)] = rank[have:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        have *= 2
    return np.argsort(rank, kind="stable")


class FMIndex:
    LEVELS = 8

    def __init__(self, text: np.ndarray, depth: int):
        """text: symbols 1 to 255, with 0 as a separator that no pattern holds."""
        self.n = len(text)
        order = sort_suffixes(text, depth)
        now = text[order - 1]  # the BWT
        self.words, self.blocks, self.zeros = [], [], []
        for level in range(self.LEVELS - 1, -1, -1):
            bit = (now >> level) & 1
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.blocks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))])[:-1].astype(np.int32))
            self.zeros.append(self.n - int(bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        count = np.bincount(text, minlength=256)
        self.smaller = np.cumsum(count) - count
        self.count = count
        # Where each symbol's block begins in the last order, to be taken off a mapped position.
        self.base = self.smaller - self._walk(np.arange(256, dtype=np.uint8), np.zeros(256, np.int64))

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        block = i >> 6
        below = (_U(1) << (i & 63).astype(np.uint64)) - _U(1)
        return self.blocks[level][block] + np.bitwise_count(self.words[level][block] & below)

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.LEVELS):
            ones = self._ones(k, i)
            i = np.where((symbol >> (self.LEVELS - 1 - k)) & 1, self.zeros[k] + ones, i - ones)
        return i

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Extend matches to the left by a symbol each."""
        both = self._walk(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) + np.tile(self.base[symbol], 2)
        return both[: len(lo)], both[len(lo) :]

    def repeated(self, text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """Which patterns text[start : start + length] occur twice or more in the index.

        Matching statistics by backward search; a pattern leaves as soon as its
        interval holds fewer than two suffixes.
        """
        out = np.zeros(len(starts), bool)
        alive = np.arange(len(starts))
        last = text[starts + length - 1]
        lo = self.smaller[last]
        hi = lo + self.count[last]
        for j in range(length - 2, -1, -1):
            lo, hi = self.step(text[starts[alive] + j], lo, hi)
            two = hi - lo >= 2
            alive, lo, hi = alive[two], lo[two], hi[two]
            if not len(alive):
                return out
        out[alive] = True
        return out
