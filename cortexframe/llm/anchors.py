"""Content-defined cuts: every window of ``length`` units belongs to one anchor.

The anchor of a window is the place of its least gram hash (the leftmost of equals) among the grams inside it. It
depends on the content of the window alone, so equal windows have equal grams at equal distances. All windows of one
anchor form a stretch, and a text of n units has about 2 n / window stretches. Comparing stretches by anchor gram
finds every pair of equal windows without a row per window.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Stretches(NamedTuple):
    text: np.ndarray  # number of the text
    anchor: np.ndarray  # place of the anchor gram
    first: np.ndarray  # place of the first window
    last: np.ndarray  # place of the last window


def stretches(grams: np.ndarray, offsets: np.ndarray, gram: int, length: int, one_in: int = 1) -> Stretches:
    """Stretches of texts that lie one after another at ``offsets``.

    ``grams[i]`` is the hash of the ``gram`` units from place ``i``. Only one in ``one_in`` hashes (those below a
    threshold) can be anchors; a window without such a hash is anchored at its own start.
    """
    sizes = np.diff(offsets)
    reach = length - gram + 1  # grams in a window
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    stop = np.repeat(offsets[1:], sizes)
    place = np.arange(offsets[-1])
    able = place + gram <= stop
    if one_in > 1:
        able[: len(grams)] &= grams[: len(able)] < np.uint64((1 << 64) // one_in)
    at = np.flatnonzero(able)
    h = grams[at]
    before = _nearest(at, h, text_of[at], reach, backward=True)
    after = _nearest(at, h, text_of[at], reach, backward=False)
    start, end = offsets[:-1][text_of[at]], offsets[1:][text_of[at]]
    first = np.maximum(np.maximum(at - reach + 1, before + 1), start)
    last = np.minimum(np.minimum(at, after - reach), end - length)
    own = first <= last
    out = [text_of[at][own], at[own], first[own], last[own]]
    if one_in > 1:
        # windows that no anchor holds
        count = np.zeros(len(place) + 1, np.int32)
        np.add.at(count, out[2], 1)
        np.subtract.at(count, out[3] + 1, 1)
        alone = np.flatnonzero((np.cumsum(count[:-1]) == 0) & (place + length <= stop))
        out = [np.concatenate((a, b)) for a, b in zip(out, (text_of[alone], alone, alone, alone))]
    return Stretches(*out)


def _nearest(at: np.ndarray, h: np.ndarray, text: np.ndarray, reach: int, backward: bool) -> np.ndarray:
    """Place of the nearest smaller hash within ``reach`` (backward: smaller or equal), or a place beyond reach."""
    n = len(at)
    out = at - reach if backward else at + reach
    open_ = np.arange(n)
    step = 1
    while len(open_):
        other = open_ - step if backward else open_ + step
        inside = (other >= 0) if backward else (other < n)
        open_, other = open_[inside], other[inside]
        near = (text[other] == text[open_]) & (np.abs(at[other] - at[open_]) < reach)
        open_, other = open_[near], other[near]
        less = h[other] <= h[open_] if backward else h[other] < h[open_]
        out[open_[less]] = at[other[less]]
        open_ = open_[~less]
        step += 1
    return out
