"""Fixed and sliding windows, runs, extrema and smoothing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.chunks import CHUNK, CHUNK_SAMPLES, SERIES, runs, sample_halo, signal_chunks
from ..plans.joins import spread_join
from .aggregates import peak_to_peak
from .signals import zero_samples


def fixed_epochs(signals: DataFrame, length: float, fs: float, keys: list[str] = SERIES) -> DataFrame:
    """Number full epochs of ``int(length * fs)`` samples; the tail is dropped."""
    n = int(length * fs)
    sizes = signals.groupBy(*keys).agg(F.floor((F.max("sample_idx") + 1) / n).alias("_full"))
    out = spread_join(signals, sizes, keys, "sample_idx")
    out = out.withColumn("epoch_idx", F.floor(F.col("sample_idx") / n).cast("bigint")).filter("epoch_idx < _full")
    return out.withColumn("offset", F.col("sample_idx") % n).drop("_full")


def sliding_windows(df: DataFrame, window: int, step: int, keys: list[str]) -> DataFrame:
    """Repeat every row for each window ``win`` (start ``win * step``) that covers it and ends inside the series."""
    sizes = df.groupBy(*keys).agg(F.floor((F.max("sample_idx") + 1 - window) / step).alias("_last"))
    i = F.col("sample_idx")
    first = F.greatest(F.ceil((i - window + 1) / step), F.lit(0))
    last = F.least(F.floor(i / step), F.col("_last"))
    out = spread_join(df, sizes, keys, "sample_idx").withColumn("_f", first).withColumn("_l", last).filter("_f <= _l")
    out = out.withColumn("win", F.explode(F.sequence(F.col("_f").cast("bigint"), F.col("_l").cast("bigint"))))
    return out.withColumn("offset", i - F.col("win") * step).drop("_f", "_l", "_last")


def longest_flat_run(signals: DataFrame, window: int, threshold: float = 1e-6, chunk: int = CHUNK_SAMPLES) -> DataFrame:
    """Longest stretch of consecutive full windows whose range stays below ``threshold``; 0 if none."""
    p2p = peak_to_peak(signals, window).withColumn("flat", F.col("p2p") < threshold)
    stretches = runs(signal_chunks(p2p, chunk, "win"), SERIES, "win", "flat")
    return stretches.groupBy(*SERIES).agg(
        F.coalesce(F.max(F.when(F.col("flat"), F.col("run_len"))), F.lit(0)).alias("longest")
    )


def binary_to_annotations(vectors: DataFrame, fs: float, prefix: str = "Sleep_", chunk: int = CHUNK_SAMPLES) -> DataFrame:
    """Runs of ones in binary stage vectors ``(recording_id, stage, sample_idx, bit)`` as annotations."""
    ones = runs(signal_chunks(vectors, chunk), ["recording_id", "stage"], "sample_idx", "bit").filter("bit = 1")
    return ones.select(
        "recording_id", (F.col("run_start") / F.lit(float(fs))).alias("onset"),
        (F.col("run_len") / F.lit(float(fs))).alias("duration"), F.concat(F.lit(prefix), F.col("stage")).alias("description"),
    )


def local_maxima(signals: DataFrame, keys: list[str] = SERIES, value: str = "value", chunk: int = CHUNK_SAMPLES) -> DataFrame:
    """Samples strictly above both neighbours; plateaus give none."""
    halo = sample_halo(signals, 1, 1, chunk)
    w = Window.partitionBy(*keys, CHUNK).orderBy("sample_idx")
    x = F.col(value)
    peak = (x > F.lag(value).over(w)) & (x > F.lead(value).over(w))
    return halo.withColumn("_peak", peak).filter("_own AND _peak").select(*signals.columns)


def reassemble(epochs: DataFrame, epoch_samples: int, totals: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Epochs back to a continuous signal of ``total`` samples: cut, or zero-padded at the end."""
    flat = epochs.select(*keys, (F.col("epoch_idx") * epoch_samples + F.col("offset")).alias("sample_idx"), "value")
    have = flat.groupBy(*keys).agg((F.max("sample_idx") + 1).alias("_lo"))
    pad = have.join(totals, keys).select(*keys, "_lo", F.col("total").alias("_hi"))
    cut = spread_join(flat, totals, keys, "sample_idx").filter("sample_idx < total").select(*flat.columns)
    return cut.unionByName(zero_samples(pad).select(*flat.columns))


def _hat(window: int, order: int) -> list[list[float]]:
    a = np.vander(np.arange(window, dtype=float) - window // 2, order + 1)
    return (a @ np.linalg.pinv(a)).tolist()


def _fit(w: int, hat, n, axis: str, value: str):
    """Fitted value at position ``i`` from the ``w`` points of its (edge-clamped) window."""

    def at(p, i):
        s = F.least(F.greatest(i - w // 2, F.lit(0)), n - w)
        terms = F.zip_with(F.get(hat, i - s), F.slice("_p", s + 1, w), lambda c, q: c * q[value])
        return F.struct(p[axis].alias(axis), F.aggregate(terms, F.lit(0.0), lambda a, t: a + t).alias("_v"))

    return at


def savgol(df: DataFrame, keys: list[str], axis: str = "freq", value: str = "power_db", window: int = 7, order: int = 3) -> DataFrame:
    """Polynomial smoothing along a short axis (a spectrum); end points use the fit of the end window.

    Series shorter than the window use the largest odd length; below ``order + 2`` points nothing is smoothed.
    """
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(axis, value))).alias("_p"))
    n = F.size("_p")
    smooth = F.lit(None)
    for w in range(window if window % 2 else window - 1, order + 1, -2):
        hat = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in _hat(w, order)])

        cond = n >= w if w >= window - 1 else n.isin(w, w + 1)
        smooth = F.when(cond, F.transform("_p", _fit(w, hat, n, axis, value))).otherwise(smooth)
    raw = F.transform("_p", lambda p: F.struct(p[axis].alias(axis), p[value].cast("double").alias("_v")))
    out = packed.select(*keys, F.explode(F.coalesce(smooth, raw)).alias("_q"))
    return out.select(*keys, F.col(f"_q.{axis}").alias(axis), F.col("_q._v").alias(value))
