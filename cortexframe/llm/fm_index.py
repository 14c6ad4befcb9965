"""Compressed full-text index: Burrows-Wheeler transform in a wavelet structure of bit vectors, searched backwards."""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with a count before every 64 of them."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.blocks = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.blocks).astype(np.int32)
        self.before = np.concatenate((np.zeros(1, np.int32), np.cumsum(counts, dtype=np.int32)))

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Number of ones in front of each place."""
        block, bit = i >> 6, (i & 63).astype(np.uint64)
        below = self.blocks[block] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + np.bitwise_count(below).astype(np.int64)


class WaveletTree:
    """Rank over symbols ``0 .. size - 1``: one bit vector per level, nodes of a level side by side."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels: list[tuple[int, BitVector, int]] = []
        for shift in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> shift) & 1
            zeros = int(len(bits) - bits.sum())
            self.levels.append((shift, BitVector(bits), zeros))
            symbols = np.concatenate((symbols[bits == 0], symbols[bits == 1]))
        self.starts = np.zeros(size, np.int64)
        self.starts = self._walk(np.arange(size), np.zeros(size, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where((symbol >> shift) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in front of its place."""
        return self._walk(symbol, at) - self.starts[symbol]


def sorted_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places ordered by the ``depth`` symbols that begin there, equal ones by place."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    step = 1
    rank = _ranks(symbols[order], order, n)
    while step < depth:
        later = np.zeros(n, np.int64)
        later[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + later
        order = np.argsort(key, kind="stable")
        rank = _ranks(key[order], order, n)
        step *= 2
    return order


def _ranks(sorted_keys: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    rank = np.zeros(n, np.int64)
    if n:
        rank[order] = np.concatenate(([0], np.cumsum(sorted_keys[1:] != sorted_keys[:-1])))
    return rank


class FMIndex:
    """Index of several sequences of 64-bit symbols, for patterns of up to ``depth`` symbols."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray, depth: int):
        """``symbols`` are the sequences one after another, ``ends`` where each of them ends."""
        self.alphabet = np.unique(symbols)
        sizes = np.diff(np.concatenate(([0], ends)))
        text = np.zeros(len(symbols) + len(ends), np.int64)  # 0 stands behind each sequence
        text[np.arange(len(symbols)) + np.repeat(np.arange(len(ends)), sizes)] = self.code(symbols)
        self.order = sorted_suffixes(text, depth + 1)
        self.sequence = np.repeat(np.arange(len(ends)), sizes + 1)[self.order]
        last = text[self.order - 1]
        self.tree = WaveletTree(last, len(self.alphabet) + 1)
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1))))

    def code(self, symbols: np.ndarray) -> np.ndarray:
        """Number of each symbol from 1 on; -1 for one that does not occur."""
        at = np.searchsorted(self.alphabet, symbols)
        found = self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == symbols
        return np.where(found, at + 1, -1)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffix interval and matched length of each row of coded ``patterns``, read from its end.

        The matched length is the matching statistic of the place, cut at the length of the pattern.
        """
        count, width = patterns.shape
        lo, hi = np.zeros(count, np.int64), np.full(count, len(self.order), np.int64)
        matched = np.zeros(count, np.int64)
        alive = np.arange(count)
        for k in range(width - 1, -1, -1):
            symbol = patterns[alive, k]
            known = symbol > 0
            alive, symbol = alive[known], symbol[known]
            new_lo = self.smaller[symbol] + self.tree.rank(symbol, lo[alive])
            new_hi = self.smaller[symbol] + self.tree.rank(symbol, hi[alive])
            going = new_lo < new_hi
            alive = alive[going]
            lo[alive], hi[alive] = new_lo[going], new_hi[going]
            matched[alive] += 1
        return lo, hi, matched

    def least(self, lo: np.ndarray, hi: np.ndarray, value_of_sequence: np.ndarray) -> np.ndarray:
        """Least value among the sequences in each interval; intervals are equal or disjoint and not empty."""
        if not len(lo):
            return np.zeros(0, value_of_sequence.dtype)
        values = value_of_sequence[self.sequence]
        starts, back = np.unique(lo, return_inverse=True)
        stops = np.zeros(len(starts), np.int64)
        stops[back] = hi
        cuts = np.column_stack((starts, stops)).reshape(-1)
        padded = np.append(values, values[-1:])
        return np.minimum.reduceat(padded, cuts)[::2][back]
