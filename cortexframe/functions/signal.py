"""Filter design and array kernels (NumPy); used on the driver for design and inside tasks on blocks."""

from __future__ import annotations

import numpy as np

HAMMING_LENGTH = 3.3  # main-lobe factor of the Hamming window: taps = factor / (transition / fs)


def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def tukey(n: int, taper: float = 0.25) -> np.ndarray:
    """Periodic Tukey window: cosine flanks over the fraction ``taper``, flat between."""
    k = np.arange(n)
    edge = taper * n / 2
    w = np.ones(n)
    left, right = k <= np.floor(edge), k >= n - np.floor(edge)
    w[left] = 0.5 * (1 - np.cos(np.pi * k[left] / edge))
    w[right] = 0.5 * (1 - np.cos(np.pi * (n - k[right]) / edge))
    return w


def _odd(n: float) -> int:
    n = int(n)
    return n + 1 - n % 2


def lowpass_taps(fs: float, cut: float, transition: float) -> np.ndarray:
    """Hamming-windowed sinc low-pass with unit gain at 0 Hz; length from the transition width."""
    n = _odd(round(HAMMING_LENGTH * fs / transition))
    m = np.arange(n) - n // 2
    h = np.sinc(2 * cut / fs * m) * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1)))
    return h / h.sum()


def _centre_add(a: np.ndarray, b: np.ndarray, sign: float) -> np.ndarray:
    if len(a) < len(b):
        out = np.zeros(len(b))
        off = (len(b) - len(a)) // 2
        out[off:off + len(a)] = a
    else:
        out = a.copy()
    off = (len(out) - len(b)) // 2
    out[off:off + len(b)] += sign * b
    return out


def bandpass_taps(fs: float, low: float, high: float) -> np.ndarray:
    """Difference of two low-passes; transitions are a quarter of the edge, at least 2 Hz, inside the band."""
    low_t = min(max(0.25 * low, 2.0), low)
    high_t = min(max(0.25 * high, 2.0), fs / 2 - high)
    upper = lowpass_taps(fs, high + high_t / 2, high_t)
    lower = lowpass_taps(fs, low - low_t / 2, low_t)
    return _centre_add(upper, lower, -1.0)


def highpass_taps(fs: float, low: float) -> np.ndarray:
    """All but a low-pass; the transition is that of ``bandpass_taps``."""
    low_t = min(max(0.25 * low, 2.0), low)
    return _centre_add(np.array([1.0]), lowpass_taps(fs, low - low_t / 2, low_t), -1.0)


def notch_taps(fs: float, freqs: list[float]) -> np.ndarray:
    """Band-stops of width f/200 around each frequency with 0.5 Hz flanks."""
    h = np.array([1.0])
    for f in freqs:
        half = f / 400.0 + 0.5
        stop = _centre_add(lowpass_taps(fs, f + half - 0.25, 0.5), lowpass_taps(fs, f - half + 0.25, 0.5), -1.0)
        h = _centre_add(h, stop, -1.0)
    return h


def butter_zpk(order: int, band: tuple[float | None, float | None], fs: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of a digital Butterworth filter by the bilinear transform; ``band`` is ``(low, high)``,
    None = open end."""
    low, high = band
    proto = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    warp = lambda f: 2 * fs * np.tan(np.pi * f / fs)
    if low is None:
        z, p, k = np.array([]), proto * warp(high), warp(high) ** order
    elif high is None:
        z, p, k = np.zeros(order), warp(low) / proto, np.real(1 / np.prod(-proto))
    else:
        w0, bw = np.sqrt(warp(low) * warp(high)), warp(high) - warp(low)
        half = proto * bw / 2
        root = np.sqrt(half**2 - w0**2 + 0j)
        z, p, k = np.zeros(order), np.concatenate([half + root, half - root]), bw**order
    c = 2 * fs
    gain = k * np.real(np.prod(c - z) / np.prod(c - p))
    zd = np.concatenate([(c + z) / (c - z), -np.ones(len(p) - len(z))])
    return zd, (c + p) / (c - p), float(gain)


def butter_sections(order: int, band: tuple[float | None, float | None], fs: float) -> tuple[np.ndarray, np.ndarray]:
    """``(b, a)`` of a digital Butterworth filter."""
    zeros, poles, gain = butter_zpk(order, band, fs)
    return np.real(gain * np.poly(zeros)), np.real(np.poly(poles))


def fft_convolve(x: np.ndarray, h: np.ndarray, mode: str = "valid") -> np.ndarray:
    n = len(x) + len(h) - 1
    size = 1 << (n - 1).bit_length()
    y = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[:n]
    return y[len(h) - 1:len(x)] if mode == "valid" else y


def odd_extend(x: np.ndarray, left: int, right: int) -> np.ndarray:
    """Point reflection about the end samples; zeros where the signal is shorter than the extension."""
    def side(y, n):
        take = min(n, len(y) - 1)
        ext = 2 * y[0] - y[take:0:-1]
        return np.concatenate([np.zeros(n - take), ext])
    return np.concatenate([side(x, left), x, side(x[::-1], right)[::-1]])


def window_starts(start: int, own: int, total: int, nperseg: int, step: int) -> np.ndarray:
    """Local offsets of the windows that begin in a block and fit into block plus halo."""
    first = -start % step
    last = min(own - 1, total - nperseg)
    return np.arange(first, last + 1, step)


def window_power(x: np.ndarray, starts: np.ndarray, nperseg: int, fs: float, window: np.ndarray) -> np.ndarray:
    """One-sided power density of mean-removed, windowed segments; one row per start. ``x`` may hold several series in rows."""
    seg = np.lib.stride_tricks.sliding_window_view(x, nperseg, axis=-1)[..., starts, :]
    seg = (seg - seg.mean(axis=-1, keepdims=True)) * window
    p = np.abs(np.fft.rfft(seg, axis=-1)) ** 2 / (fs * np.sum(window**2))
    p[..., 1:(-1 if nperseg % 2 == 0 else None)] *= 2
    return p
