"""Distribution functions on arrays (NumPy)."""

from __future__ import annotations

from math import lgamma

import numpy as np

_lgamma = np.vectorize(lgamma, otypes=[float])


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 300) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz method)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps + 1):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            delta = d * c
            h *= delta
        if np.all(np.abs(delta - 1) < 1e-15):
            break
    return h


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    a, b, x = a.copy(), b.copy(), np.clip(x, 0.0, 1.0)
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    direct = inner < (a + 1) / (a + b + 2)
    low = front * _beta_fraction(a, b, np.where(direct, inner, 0.0)) / a
    high = 1 - front * _beta_fraction(b, a, np.where(direct, 0.0, 1 - inner)) / b
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(direct, low, high)))


def t_two_sided(t, df) -> np.ndarray:
    """Two-sided p-value of Student's t; NaN stays NaN and an infinite t gives 0."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    ok = np.isfinite(t)
    x = np.where(ok, df / (df + np.where(ok, t, 0.0) ** 2), 0.0)
    p = beta_inc(df / 2, 0.5, x)
    return np.where(np.isnan(t), np.nan, np.where(np.isinf(t), 0.0, p))
