"""A compressed full-text index over words: a block-sorted sequence in a wavelet matrix with packed rank bits."""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bits with the number of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.packed = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.packed)
        self.before = np.zeros(len(self.packed), np.int32)
        np.cumsum(ones[:-1], out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.packed[word] & below)


class FMIndex:
    """Index of a sequence of integer symbols 0..sigma-1; matches of up to ``depth`` symbols can be found.

    The sequence ends with 0, which no pattern holds.

    Suffixes are ordered by their first ``depth`` symbols at least, which is all
    that backward search for patterns of that length needs.
    """

    def __init__(self, symbols: np.ndarray, depth: int):
        n = len(symbols)
        rank, step = symbols.astype(np.int64), 1
        self.order = np.argsort(rank, kind="stable")
        while step < depth and n:
            following = np.zeros(n, np.int64)
            following[: n - step] = rank[step:] + 1 if n > step else 0
            key = rank * (int(rank.max()) + 2) + following
            self.order = np.argsort(key)
            ordered = key[self.order]
            new = np.empty(n, np.int64)
            new[0] = 0
            np.cumsum(ordered[1:] != ordered[:-1], out=new[1:])
            rank = np.empty(n, np.int64)
            rank[self.order] = new
            step *= 2
        last = symbols[self.order - 1]
        sigma = int(symbols.max()) + 1 if n else 1
        self.first = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(symbols, minlength=sigma), out=self.first[1:])
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            bit = (last >> shift) & 1
            self.levels.append((shift, Bits(bit), int(n - bit.sum())))
            last = np.concatenate((last[bit == 0], last[bit == 1]))
        self.base = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> shift) & 1, zeros + ones, at - ones)
        return at

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Backward step: where suffixes that begin with ``symbol`` before the suffixes from ``at`` on lie."""
        return self.first[symbol] + self._walk(symbol, at) - self.base[symbol]

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, most: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each end the length of the longest part of ``text`` before it (``most`` symbols at most) that the index holds ``least`` times, and its interval [lo, hi) of ``order``.

        ``text`` is a stream of the same symbols, those that the index lacks as -1.  All
        ends take a step to the left at once; an end drops out where fewer than ``least`` places are left.
        """
        length, low, high = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64), np.full(len(ends), len(self.order))
        open_ = np.arange(len(ends))
        for back in range(1, most + 1):
            at = ends[open_] - back
            open_, at = open_[at >= 0], at[at >= 0]
            symbol = text[at]
            open_, symbol = open_[symbol >= 0], symbol[symbol >= 0]
            if not len(open_):
                break
            both = self.step(np.concatenate((symbol, symbol)), np.concatenate((low[open_], high[open_])))
            lo, hi = both[: len(symbol)], both[len(symbol) :]
            found = hi - lo >= least
            open_, lo, hi = open_[found], lo[found], hi[found]
            length[open_], low[open_], high[open_] = back, lo, hi
        return length, low, high
