"""Power spectra from haloed signal blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signal as sg
from ..plans.blocks import BLOCK_SAMPLES, to_blocks, with_halo
from ..plans.chunks import SERIES

# EEG bands in Hz.
BANDS = [("delta", 0.5, 4.0), ("theta", 4.0, 8.0), ("alpha", 8.0, 12.0), ("beta", 12.0, 30.0), ("gamma", 30.0, 40.0)]


def to_db(power: Column) -> Column:
    """``10 log10(p)`` with an explicit negative infinity for zero power."""
    return F.when(power == 0, F.lit(float("-inf"))).otherwise(10 * F.log10(power))


def _windows(nperseg: int, step: int, fs: float, window: str, mean: bool):
    shape = sg.tukey if window == "tukey" else sg.hann

    def alike(x, start, n_right):
        """One result per row of ``x``: blocks of one length that start at the same place and have as long a halo."""
        n, total = nperseg, x.shape[1]
        if start == 0 and total < nperseg:  # block and halo hold the whole series, which is shorter than a window
            n = total
        starts = sg.window_starts(start, total - n_right, total, n, step if n == nperseg else n)
        if not len(starts) or n < 1:
            return [([], [], [], 0)] * len(x)
        p = sg.window_power(x, starts, n, fs, shape(n))
        freqs = np.arange(p.shape[2]) * fs / n
        if mean:
            return [(freqs, row, [], len(starts)) for row in p.sum(axis=1)]
        at = (start + starts + n / 2) / fs
        return [(np.tile(freqs, len(starts)), row.ravel(), np.repeat(at, len(freqs)), len(starts)) for row in p]

    @F.pandas_udf("freq array<double>, power array<double>, time array<double>, n bigint")
    def udf(samples: pd.Series, start: pd.Series, n_right: pd.Series) -> pd.DataFrame:
        rows: list = [None] * len(samples)
        groups: dict[tuple, list[int]] = {}
        for i, (x, s, r) in enumerate(zip(samples, start, n_right)):
            groups.setdefault((len(x), int(s), int(r)), []).append(i)
        for (total, s, r), own in groups.items():
            many = max(1, BLOCK_SAMPLES // max(total, 1))  # windows overlap, so few samples at a time
            for at in range(0, len(own), many):
                part = own[at:at + many]
                x = np.stack([np.asarray(samples.iloc[i], dtype=float) for i in part])
                for i, row in zip(part, alike(x, s, r)):
                    rows[i] = row
        return pd.DataFrame(rows, columns=["freq", "power", "time", "n"])

    return udf


def welch_psd(
    signals: DataFrame, fs: float, nperseg: int, fmax: float = 40.0, keys: list[str] = SERIES,
    block: int = BLOCK_SAMPLES, window: str = "hann", overlap: int | None = None,
) -> DataFrame:
    """Welch density per series: windows are averaged as partial sums per block.

    Returns ``keys, freq, power, power_db``. The shuffle after the blocks carries one spectrum per block.
    """
    step = nperseg - (nperseg // 2 if overlap is None else overlap)
    blocks = with_halo(to_blocks(signals, block, keys), 0, nperseg - 1, block, keys)
    part = blocks.select(*keys, _windows(nperseg, step, fs, window, True)("samples", "start_sample", "n_right").alias("s"))
    flat = part.select(*keys, "s.n", F.explode(F.arrays_zip("s.freq", "s.power")).alias("z"))
    out = flat.filter(F.col("z.freq") <= fmax).groupBy(*keys, F.col("z.freq").alias("freq")).agg(
        (F.sum("z.power") / F.sum("n")).alias("power")
    )
    return out.withColumn("power_db", to_db(F.col("power")))


def segment_psd(segments: DataFrame, fs: float, nperseg: int, fmax: float = 40.0) -> DataFrame:
    """Spectrum of every ``(recording, condition, segment, channel)``."""
    keys = ["recording_id", "condition", "segment_idx", "channel"]
    return welch_psd(segments, fs, nperseg, fmax, keys).select(*keys, "freq", "power_db")


def spectrogram(
    signals: DataFrame, fs: float, nperseg: int, noverlap: int, window: str = "tukey",
    fmin: float = 0.0, fmax: float = 40.0, include_fmax: bool = False, keys: list[str] = SERIES,
    block: int = BLOCK_SAMPLES,
) -> DataFrame:
    """Power density in dB per window; ``time`` is the window centre in seconds."""
    blocks = with_halo(to_blocks(signals, block, keys), 0, nperseg - 1, block, keys)
    udf = _windows(nperseg, nperseg - noverlap, fs, window, False)
    part = blocks.select(*keys, udf("samples", "start_sample", "n_right").alias("s"))
    flat = part.select(*keys, F.explode(F.arrays_zip("s.freq", "s.power", "s.time")).alias("z"))
    top = F.col("z.freq") <= fmax if include_fmax else F.col("z.freq") < fmax
    return flat.filter((F.col("z.freq") >= fmin) & top).select(
        *keys, F.col("z.time").alias("time"), F.col("z.freq").alias("freq"), to_db(F.col("z.power")).alias("power_db")
    )


def band_power(psd: DataFrame, keys: list[str], value: str = "power_db") -> DataFrame:
    """Mean over the bins of each EEG band; bands are half-open except the last."""
    band = F.lit(None)
    for i, (name, lo, hi) in enumerate(BANDS):
        top = F.col("freq") <= hi if i == len(BANDS) - 1 else F.col("freq") < hi
        band = F.when((F.col("freq") >= lo) & top, name).otherwise(band)
    return psd.withColumn("band", band).filter("band IS NOT NULL").groupBy(*keys, "band").agg(
        F.avg(value).alias(value)
    )
