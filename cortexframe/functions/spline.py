"""Spherical-spline interpolation weights (Perrin et al. 1989)."""

from __future__ import annotations

import numpy as np


def spline_kernel(cosine: np.ndarray, stiffness: int = 4, terms: int = 50) -> np.ndarray:
    """Sum of Legendre polynomials with weights ``(2n + 1) / (n (n + 1))**m / (4 pi)``."""
    n = np.arange(1, terms + 1)
    coef = np.concatenate([[0.0], (2 * n + 1) / (n * (n + 1.0)) ** stiffness / (4 * np.pi)])
    return np.polynomial.legendre.legval(np.clip(cosine, -1, 1), coef)


def spline_weights(good: np.ndarray, bad: np.ndarray, smoothing: float = 1e-5) -> np.ndarray:
    """Matrix ``(bad, good)`` that predicts the bad channels from the good ones."""
    unit = lambda p: p / np.linalg.norm(p, axis=1, keepdims=True)
    g, b = unit(np.asarray(good, float)), unit(np.asarray(bad, float))
    k = len(g)
    system = np.ones((k + 1, k + 1))
    system[:k, :k] = spline_kernel(g @ g.T) + smoothing * np.eye(k)
    system[k, k] = 0.0
    target = np.hstack([spline_kernel(b @ g.T), np.ones((len(b), 1))])
    return target @ np.linalg.pinv(system)[:, :k]
