"""NumPy kernels over a batch of texts: words, hashes and SuperMinHash signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_GOLD = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KIND = np.array([0 if _SPACE[b] else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)
_BYTE_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BASE = _U(0xD1342543DE82EF95 & ~7 | 3)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array (null: empty) and the offsets of its texts."""
    filled = pc.fill_null(texts, "").cast(pa.large_string())
    filled = pa.concat_arrays([filled]) if filled.offset == 0 else pa.array(filled.to_pylist(), pa.large_string())
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[: len(filled) + 1]
    raw = filled.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[: offsets[-1]] if raw is not None and len(filled) else np.zeros(0, np.uint8)
    return data, offsets if len(filled) else np.zeros(1, np.int64)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every white-space word, and for each text the number of words before it."""
    return _runs((~_SPACE[data]).view(np.uint8), offsets)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``words``, for runs of letters and digits (all bytes from 128 on count) and runs of other signs."""
    return _runs(_KIND[data], offsets)


def _runs(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of one kind above 0 that stay inside a text."""
    solid = kind > 0
    change = kind[1:] != kind[:-1] if len(kind) else np.zeros(0, bool)
    first, last = solid.copy(), solid.copy()
    first[1:] &= change
    last[:-1] &= change
    inner = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[inner] = solid[inner]
    inner = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[inner] = solid[inner]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words given by their byte ranges."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    longest = int((ends - starts).max())
    powers = np.cumprod(np.full(longest, _BASE))
    size = ends - starts
    at = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size)
    values = _BYTE_VALUES[data[np.repeat(starts, size) + at]] * powers[at]
    return mix(np.add.reduceat(values, np.cumsum(size) - size) + size.astype(np.uint64) * _U(_GOLD))


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive entries."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(hashes) - n + 1, _U(n * _GOLD & _M))
    for k in range(n):
        out = mix(out * _U(3) + hashes[k:len(hashes) - n + 1 + k])
    return out


def shingle_sets(hashes: np.ndarray, word_offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct ``k``-word shingles of each text; a shorter text is one shingle, an empty one has none."""
    out = []
    for lo, hi in zip(word_offsets[:-1].tolist(), word_offsets[1:].tolist()):
        out.append(np.unique(chain(hashes[lo:hi], min(k, hi - lo))) if hi > lo else hashes[:0])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def superminhash(elements: np.ndarray, group: np.ndarray, groups: int, m: int) -> np.ndarray:
    """SuperMinHash signatures, one row of ``m`` 64-bit ranks for each group.

    An element puts a random rank ``j + r`` on the component at place ``j`` of its own random permutation, for
    ``j = 0, 1, ...``; a component keeps the least rank. All groups go through the places together. A group stops at
    the first place after which each of its components has a rank, as later ranks are larger.
    """
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    signature = np.full((groups, m), none)
    flat = signature.reshape(-1)
    own, base, order = elements, group * m, None
    for j in range(m):
        if not len(own):
            break
        drawn = mix(own + _U((j + 1) * _GOLD & _M))
        k = j + (((drawn >> _U(32)) * _U(m - j)) >> _U(32)).astype(np.int64)
        if order is None:
            part = k
        else:
            rows = np.arange(len(own))
            part = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, j]
        np.minimum.at(flat, base + part, _U(j << 32) | (drawn & _U(0xFFFFFFFF)))
        left = (signature == none).any(axis=1)[base // m]
        if order is None:
            own, base, k = own[left], base[left], k[left]
            order = np.tile(np.arange(m, dtype=np.uint16), (len(own), 1))
            order[np.arange(len(own)), k] = 0
        else:
            own, base, order = own[left], base[left], order[left]
    return signature


class RangeHash:
    """64-bit hashes of ranges of a sequence, from prefix sums of ``values[i] * base^i`` modulo 2^64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, base: int):
        up, self.down = self._tables(base, len(values))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])))

    @classmethod
    def _tables(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        known = cls._powers.get(base)
        if known is None or len(known[0]) <= n:
            size = max(n + 1, 1 << 20)
            tables = []
            for b in (base, pow(base, -1, 1 << 64)):
                steps = np.full(size, _U(b))
                steps[0] = _U(1)
                tables.append(np.cumprod(steps))
            known = cls._powers[base] = (tables[0], tables[1])
        return known

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of ``[start, end)``; the length counts as well."""
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw + (end - start).astype(np.uint64) * _U(_GOLD))


BASES = (0x9E3779B97F4A7C13, 0xD1B54A32D192ED03)  # both leave 3 when divided by 8
