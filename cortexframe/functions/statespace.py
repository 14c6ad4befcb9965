"""Recursive filters as linear state-space systems: cascades of second-order sections that run on blocks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .signal import butter_zpk

STRETCH = 128  # samples that one matrix product covers


def butter_sos(order: int, band: tuple[float | None, float | None], fs: float) -> list[tuple[float, ...]]:
    """Butterworth sections ``(b0, b1, b2, a1, a2)``; a pair of poles each, the gain on the first one."""
    zeros, poles, gain = butter_zpk(order, band, fs)
    pairs = [(p, p.conjugate()) for p in poles if p.imag > 1e-12]
    real = sorted(p.real for p in poles if abs(p.imag) <= 1e-12)
    pairs += [tuple(real[i:i + 2]) for i in range(0, len(real), 2)]
    high = sorted((z.real for z in zeros), reverse=True)
    out = []
    for pair in sorted(pairs, key=lambda ps: -max(abs(p) for p in ps)):
        # zeros lie at 1 and -1; a section takes one from each end of the list
        own = [high.pop(0)] if high else []
        if len(pair) == 2 and high:
            own.append(high.pop())
        b = np.poly(own) * (gain if not out else 1.0)
        a = np.real(np.poly(pair))
        out.append((*np.pad(b, (0, 3 - len(b))).tolist(), *np.pad(a[1:], (0, 3 - len(a))).tolist()))
    return out


class StateFilter:
    """``z' = A z + B x``, ``y = C z + D x`` for a cascade of sections.

    A block is cut into stretches: the response to a stretch is a product with a triangular Toeplitz matrix, and
    only the states between stretches are computed one after the other. Several series run side by side as rows.
    """

    def __init__(self, sections: tuple[tuple[float, ...], ...]):
        p = 2 * len(sections)
        self.A, self.B, self.C, self.D = np.zeros((p, p)), np.zeros(p), np.zeros(p), 1.0
        for k, (b0, b1, b2, a1, a2) in enumerate(sections):
            own, before = slice(2 * k, 2 * k + 2), slice(0, 2 * k)
            into = np.array([b1 - a1 * b0, b2 - a2 * b0])
            self.A[own, own] = [[-a1, 1.0], [-a2, 0.0]]
            self.A[own, before] = np.outer(into, self.C[before])
            self.B[own] = into * self.D
            self.C[before] *= b0
            self.C[2 * k] = 1.0
            self.D *= b0
        self.size = p
        self.steady = np.linalg.solve(np.eye(p) - self.A, self.B)  # state of a constant input of 1
        powers = [np.eye(p)]
        for _ in range(STRETCH):
            powers.append(self.A @ powers[-1])
        self.powers = np.stack(powers)
        self.out = self.C @ self.powers[:STRETCH]  # what a state adds to the samples of a stretch
        self.into = self.powers[:STRETCH][::-1] @ self.B  # what the samples of a stretch add to its end state
        response = np.concatenate(([self.D], self.out[:-1] @ self.B))
        shift = np.arange(STRETCH)[:, None] - np.arange(STRETCH)
        self.own = np.where(shift >= 0, response[np.maximum(shift, 0)], 0.0)

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output and end state of rows ``x`` from the start states ``state``."""
        rows, n = x.shape
        whole = n // STRETCH
        body = x[:, :whole * STRETCH].reshape(rows, whole, STRETCH)
        added = body @ self.into
        at = np.empty((rows, whole, self.size))
        step = self.powers[STRETCH].T
        for i in range(whole):
            at[:, i] = state
            state = state @ step + added[:, i]
        y = (body @ self.own.T + at @ self.out.T).reshape(rows, whole * STRETCH)
        left = n - whole * STRETCH
        if left:
            rest = x[:, whole * STRETCH:]
            last = rest @ self.own[:left, :left].T + state @ self.out[:left].T
            state = state @ self.powers[left].T + rest @ self.into[STRETCH - left:]
            y = np.concatenate((y, last), axis=1)
        return y, state

    def both_ways(self, x: np.ndarray, state: np.ndarray, back: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward, then backward over one block: output, forward and backward end state.

        ``back`` is the state of the backward run at the block's end; None starts it as if the last value had gone on
        for ever, as at the end of a series.
        """
        y, end = self.run(x, state)
        turned = y[:, ::-1]
        w, back_end = self.run(turned, turned[:, :1] * self.steady if back is None else back)
        return w[:, ::-1], end, back_end

    @lru_cache(maxsize=64)
    def carried(self, n: int, last: bool) -> np.ndarray:
        """How a block of ``n`` samples maps its forward start state to its backward end state."""
        start = np.eye(self.size)
        _, _, back = self.both_ways(np.zeros((self.size, n)), start, None if last else np.zeros((self.size, self.size)))
        return back.T


@lru_cache(maxsize=16)
def state_filter(sections: tuple[tuple[float, ...], ...]) -> StateFilter:
    return StateFilter(sections)
