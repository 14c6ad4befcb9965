"""Zero-phase filters and resampling on haloed blocks, and per-series detrending."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signal as sg
from ..functions.statespace import butter_sos, state_filter
from ..plans.blocks import BLOCK_SAMPLES, to_blocks, to_samples, with_halo
from ..plans.chunks import CHUNK, CHUNK_SAMPLES, SERIES, sample_halo
from ..plans.joins import lookup_join, place_join, spread_join
from ..plans.materialize import materialize
from ..plans.scan import affine_scan
from .aggregates import standardize
from .signals import drop_nonfinite_series


def fir_chain(window: np.ndarray, n_left: int, n_right: int, taps: list[np.ndarray]) -> np.ndarray:
    """Apply symmetric FIR filters one after the other to a block with halo and return the block.

    Where the halo is cut short the recording ends there, and every filter sees the point reflection of its
    own input at that end; elsewhere the halo supplies the real neighbours.
    """
    need = sum(len(t) // 2 for t in taps)
    own = len(window) - n_left - n_right
    at_start, at_end = n_left < need, n_right < need
    x = window
    for t in taps:
        half = len(t) // 2
        if at_start or at_end:
            x = sg.odd_extend(x, half if at_start else 0, half if at_end else 0)
        x = sg.fft_convolve(x, t)
    first = n_left if at_start else 0
    return x[first:first + own]


def fir_filter(signals: DataFrame, taps: dict[str, list[np.ndarray]] | list[np.ndarray], types: DataFrame | None = None,
               block: int = BLOCK_SAMPLES, keys: list[str] = SERIES, bridge: bool = False) -> DataFrame:
    """Filter every series; with a typed channel table the taps are chosen by ``ch_type`` (others pass through).

    With ``bridge`` a sample without a value stays so and the filter meets a straight line in its place; otherwise all samples
    that are filtered together with it lose theirs.
    """
    by_type = taps if isinstance(taps, dict) else {"": taps}
    halo = max([sum(len(t) // 2 for t in ts) for ts in by_type.values()], default=0)
    blocks = with_halo(to_blocks(signals, block, keys), halo, halo, block, keys)
    if isinstance(taps, dict):
        kinds = types.select(*keys, "ch_type").dropDuplicates(keys)
        blocks = lookup_join(blocks, kinds, keys, "left").withColumn("ch_type", F.coalesce("ch_type", F.lit("misc")))
    else:
        blocks = blocks.withColumn("ch_type", F.lit(""))

    def one(x, left, right, kind):
        x = np.asarray(x, dtype=float)
        chain = by_type.get(kind)
        if not chain:
            return x[left:len(x) - right]
        need = sum(len(t) // 2 for t in chain)  # a shorter filter uses only its part of the common halo
        l, r = min(left, need), min(right, need)
        gaps = np.isnan(x)
        bridged = bridge and gaps.any() and not gaps.all()
        if bridged:
            x = np.interp(np.arange(len(x)), np.flatnonzero(~gaps), x[~gaps])
        out = fir_chain(x[left - l:len(x) - (right - r)], l, r, chain)
        return np.where(gaps[left:len(x) - right], np.nan, out) if bridged else out

    @F.pandas_udf("array<double>")
    def apply(x: pd.Series, left: pd.Series, right: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([one(*row) for row in zip(x, left, right, kind)], dtype=object)

    out = blocks.select(*keys, "start_sample", apply("samples", "n_left", "n_right", "ch_type").alias("samples"))
    return to_samples(out, keys)


def type_taps(fs: float, variant: str = "clean") -> dict[str, list[np.ndarray]]:
    """Band-pass and notch taps per channel type; ``variant="stim"`` uses 1-20 Hz for EOG.

    A band that ends above the highest frequency of the series has no upper edge there: its lower edge is a high-pass.
    """
    # Pass bands in Hz.
    bands = {"eeg": (0.5, 40.0), "eog": (0.5, 15.0) if variant == "clean" else (1.0, 20.0),
             "emg": (15.0, min(100.0, fs / 2 - 1)), "ecg": (0.5, 35.0)}
    notch = {"eeg": [50.0] if fs > 100 else [], "eog": [50.0] if fs > 100 else [], "ecg": [],
             "emg": [50.0] if 100 < fs < 200 else [50.0, 100.0] if fs > 200 else []}
    out = {}
    for kind, (lo, hi) in bands.items():
        out[kind] = [sg.bandpass_taps(fs, lo, hi) if hi < fs / 2 else sg.highpass_taps(fs, lo)] if 0 < lo < min(hi, fs / 2) else []
        if notch[kind]:
            out[kind].append(sg.notch_taps(fs, notch[kind]))
    return out


def fir_bandpass(signals: DataFrame, fs: float, low: float, high: float, block: int = BLOCK_SAMPLES) -> DataFrame:
    return fir_filter(signals, [sg.bandpass_taps(fs, low, high)], block=block)


def notch(signals: DataFrame, fs: float, freqs: list[float], block: int = BLOCK_SAMPLES) -> DataFrame:
    return fir_filter(signals, [sg.notch_taps(fs, freqs)], block=block)


def _series_ends(blocks: DataFrame, pad: int, size: int, keys: list[str]) -> tuple[DataFrame, bool]:
    """One row for the first and one for the last block of every series, with the point reflection of up to ``pad``
    samples about the end samples in ``_left`` and ``_right``; and whether a series has several blocks."""
    span = materialize(blocks.groupBy(*keys).agg(F.min("block_idx").alias("_first"), F.max("block_idx").alias("_last")))
    several = span.filter("_last > _first").limit(1).count() > 0
    reach = -(-(pad + 1) // size)
    near = spread_join(blocks, span, keys, "block_idx").filter(
        (F.col("block_idx") - F.col("_first") <= reach) | (F.col("_last") - F.col("block_idx") <= reach))
    n = F.size("samples")
    head = F.when(F.col("block_idx") - F.col("_first") <= reach, F.struct("block_idx", F.slice("samples", 1, pad + 1).alias("part")))
    took = F.least(n, F.lit(pad + 1))
    tail = F.when(F.col("_last") - F.col("block_idx") <= reach, F.struct("block_idx", F.slice("samples", n - took + 1, took).alias("part")))
    ends = near.groupBy(*keys, "_first", "_last").agg(
        F.array_sort(F.collect_list(head))["part"].alias("_h"), F.array_sort(F.collect_list(tail))["part"].alias("_t"))
    ends = ends.withColumn("_h", F.slice(F.flatten("_h"), 1, pad + 1)).withColumn("_t", F.flatten("_t"))
    own = F.least(F.size("_t"), F.lit(pad + 1))
    ends = ends.withColumn("_t", F.slice("_t", F.size("_t") - own + 1, own))
    more = F.least(F.size("_h"), F.size("_t")) - 1
    mirrored = lambda part, at: F.transform(F.reverse(part), lambda v: 2 * at - v)
    left = mirrored(F.slice("_h", F.lit(2), more), F.get("_h", F.lit(0)))
    right = mirrored(F.slice("_t", F.size("_t") - more, more), F.element_at("_t", -1))
    none = F.array().cast("array<double>")
    row = lambda at, l, r, first, last: F.struct(
        F.col(at).alias("block_idx"), l.alias("_left"), r.alias("_right"), F.lit(first).alias("_is_first"), F.lit(last).alias("_is_last"))
    rows = F.when(F.col("_first") == F.col("_last"), F.array(row("_first", left, right, True, True))).otherwise(
        F.array(row("_first", left, none, True, False), row("_last", none, right, False, True)))
    return ends.select(*keys, F.inline(rows)), several


def filtfilt_blocks(blocks: DataFrame, sections: list[tuple[float, ...]], pad: int, size: int = BLOCK_SAMPLES,
                    keys: list[str] = SERIES) -> DataFrame:
    """Forward-backward recursive filter of stored blocks, with ``pad`` reflected samples at the ends and a steady start.

    Blocks exchange filter states, not samples. Each block runs both ways from a zero state and hands on a
    few numbers: its forward end state, its backward end state and, by linearity, how the one depends on its start state.
    Two parallel prefixes give the states in which every block starts, and a second run uses them. What is exchanged does
    not depend on how slowly the filter decays. Blocks of a series have ``size`` samples but for the first and the last.
    """
    ends, several = _series_ends(blocks, pad, size, keys)
    tagged = place_join(blocks, ends, [*keys, "block_idx"])
    fixed = tuple(map(tuple, sections))
    order = 2 * len(fixed)

    def grouped(frame: pd.DataFrame):
        """Extended blocks of equal shape, as matrices: rows, samples, cut-offs, first, last."""
        rows: dict[tuple, list[int]] = {}
        parts = []
        for i, (x, left, right, first, last) in enumerate(zip(*(frame[c] for c in ("samples", "_left", "_right", "_is_first", "_is_last")))):
            left, right = (np.zeros(0) if v is None else np.asarray(v, float) for v in (left, right))
            parts.append(np.concatenate((left, np.asarray(x, float), right)))
            rows.setdefault((len(left), len(x), len(right), bool(first), bool(last)), []).append(i)
        for (left, n, _, first, last), own in rows.items():
            yield own, np.stack([parts[i] for i in own]), slice(left, left + n), first, last

    @F.pandas_udf("fwd array<double>, bwd array<double>, n int")
    def summarize(frame: pd.DataFrame) -> pd.DataFrame:
        run = state_filter(fixed)
        out = [None] * len(frame)
        for own, x, _, first, last in grouped(frame):
            start = x[:, :1] * run.steady if first else np.zeros((len(own), order))
            _, fwd, bwd = run.both_ways(x, start, None if last else np.zeros((len(own), order)))
            for i, f, b in zip(own, fwd, bwd):
                out[i] = (f, b, x.shape[1])
        return pd.DataFrame(out, columns=["fwd", "bwd", "n"])

    @F.pandas_udf("array<double>")
    def settle(bwd: pd.Series, start: pd.Series, n: pd.Series, last: pd.Series) -> pd.Series:
        run = state_filter(fixed)
        return pd.Series([
            np.asarray(b, float) + run.carried(int(k), bool(end)) @ np.asarray(s, float) for b, s, k, end in zip(bwd, start, n, last)
        ], dtype=object)

    @F.pandas_udf("array<double>")
    def apply(frame: pd.DataFrame) -> pd.Series:
        run = state_filter(fixed)
        out = [None] * len(frame)
        for own, x, kept, first, last in grouped(frame):
            start = x[:, :1] * run.steady if first else np.stack([np.asarray(frame["_start"].iloc[i], float) for i in own])
            back = None if last else np.stack([np.asarray(frame["_back"].iloc[i], float) for i in own])
            y, _, _ = run.both_ways(x, start, back)
            for i, row in zip(own, y):
                out[i] = row[kept]
        return pd.Series(out, dtype=object)

    parts = ["samples", "_left", "_right", F.coalesce("_is_first", F.lit(False)).alias("_is_first"), F.coalesce("_is_last", F.lit(False)).alias("_is_last")]
    if several:
        place = [*keys, "block_idx"]
        step = np.linalg.matrix_power(state_filter(fixed).A, size)
        own = tagged.select(*place, parts[-1], summarize(F.struct(*parts)).alias("_s"))
        own = materialize(own.select(*place, "_is_last", "_s.*"))
        start = affine_scan(own, keys, "block_idx", "fwd", step, "_start")
        met = own.join(start, place).withColumn("_e", settle("bwd", "_start", "n", "_is_last"))
        met = materialize(met.select(*place, "_start", "_e"))
        back = affine_scan(met, keys, "block_idx", "_e", step, "_back", backward=True)
        tagged = place_join(tagged, met.drop("_e").join(back, place), place)
    else:  # every series is one block and starts and ends by itself
        zero = F.array(*[F.lit(0.0)] * order)
        tagged = tagged.withColumn("_start", zero).withColumn("_back", zero)
    return tagged.select(*keys, "block_idx", "start_sample", apply(F.struct(*parts, "_start", "_back")).alias("samples"))


def butter_filtfilt(signals: DataFrame, fs: float, order: int, band: tuple[float | None, float | None],
                    block: int = BLOCK_SAMPLES, keys: list[str] = SERIES) -> DataFrame:
    """Forward-backward Butterworth filter of long samples."""
    return to_samples(butter_blocks(materialize(to_blocks(signals, block, keys)), fs, order, band, block, keys), keys)


def butter_blocks(blocks: DataFrame, fs: float, order: int, band: tuple[float | None, float | None],
                  block: int = BLOCK_SAMPLES, keys: list[str] = SERIES) -> DataFrame:
    """``butter_filtfilt`` from stored blocks to blocks."""
    open_ends = band[0] is None or band[1] is None
    return filtfilt_blocks(blocks, butter_sos(order, band, fs), 3 * (order * (1 if open_ends else 2) + 1), block, keys)


def filter_detrend(signals: DataFrame, types: DataFrame, fs: float, variant: str = "clean", method: str = "fir",
                   block: int = BLOCK_SAMPLES) -> DataFrame:
    """Type-dependent band-pass and notch, then linear detrending."""
    if method == "fir":
        out = fir_filter(signals, type_taps(fs, variant), types, block, bridge=True)
    else:
        bands = {"eeg": (0.5, 40.0), "eog": (1.0, 20.0), "emg": (15.0, min(100.0, fs / 2 - 1)), "ecg": (0.5, 35.0)}
        typed = lookup_join(signals, types.select(*SERIES, "ch_type").dropDuplicates(SERIES), SERIES, "left")
        out = typed.filter(F.col("ch_type").isNull() | ~F.col("ch_type").isin(list(bands))).select(*signals.columns)
        for kind, band in bands.items():
            part = typed.filter(F.col("ch_type") == kind).select(*signals.columns)
            out = out.unionByName(butter_filtfilt(part, fs, 2, band, block).select(*signals.columns))
    return detrend_linear(out)


def detrend_linear(signals: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Remove the least-squares line of every series; the line comes from one partial aggregation."""
    x = F.col("sample_idx").cast("double")
    line = signals.groupBy(*keys).agg(
        F.regr_slope("value", x).alias("_b"), F.regr_intercept("value", x).alias("_a"), F.avg("value").alias("_m"))
    out = spread_join(signals, line, keys, "sample_idx")
    fit = F.coalesce(F.col("_a") + F.col("_b") * x, F.col("_m"))
    return out.withColumn("value", F.col("value") - fit).select(*signals.columns)


def series_sizes(signals: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Samples per series; on stored signals this reads only the key and index columns."""
    return signals.groupBy(*keys).agg((F.max("sample_idx") + 1).alias("n_samples"))


def resample_linear(signals: DataFrame, fs: float, fs_new: float, keys: list[str] = SERIES, chunk: int = CHUNK_SAMPLES,
                    sizes: DataFrame | None = None) -> DataFrame:
    """``int(duration * fs_new)`` points at ``j * n / n2`` by linear interpolation, held at the right end.

    Every sample emits the new points that start at it, with its successor from the same chunk (or its halo):
    one shuffle and no generated time axis. ``sizes`` spares a second evaluation of a filtered input.
    """
    size = (sizes if sizes is not None else series_sizes(signals, keys)).withColumnRenamed("n_samples", "_n")
    size = size.withColumn("_n2", (F.col("_n") / F.lit(float(fs)) * F.lit(float(fs_new))).cast("bigint"))
    halo = sample_halo(spread_join(signals, size, keys, "sample_idx"), 0, 1, chunk)
    w = Window.partitionBy(*keys, CHUNK).orderBy("sample_idx")
    nxt = halo.withColumn("_next", F.coalesce(F.lead("value").over(w), F.col("value"))).filter("_own AND _n2 > 0")
    first = lambda i: F.floor((i * F.col("_n2") + F.col("_n") - 1) / F.col("_n")).cast("bigint")
    emit = nxt.withColumn("_f", first(F.col("sample_idx"))).withColumn("_l", first(F.col("sample_idx") + 1) - 1).filter("_f <= _l")
    j = emit.select(*keys, "sample_idx", "value", "_next", "_n", "_n2", F.explode(F.sequence("_f", "_l")).alias("_j"))
    frac = (F.col("_j") * F.col("_n") - F.col("sample_idx") * F.col("_n2")) / F.col("_n2")
    return j.select(*keys, F.col("_j").alias("sample_idx"), (F.col("value") + (F.col("_next") - F.col("value")) * frac).alias("value"))


def resample_record(signals: DataFrame, fs: float, fs_new: float, block: int = BLOCK_SAMPLES) -> DataFrame:
    """Anti-alias low-pass when the rate drops, linear interpolation, z-score; channels with NaN are dropped."""
    src = signals
    if fs > fs_new:
        src = butter_filtfilt(signals, fs, 4, (None, min(fs_new / 2, fs / 2 * 0.999999)), block)
    new = materialize(resample_linear(src, fs, fs_new, sizes=series_sizes(signals)))  # read again for the moments
    return standardize(drop_nonfinite_series(new))


def resample_bandlimited(signals: DataFrame, fs: float, fs_new: float, zeros: int = 32, block: int = BLOCK_SAMPLES,
                         keys: list[str] = SERIES) -> DataFrame:
    """Windowed-sinc resampling to ``round(n * fs_new / fs)`` points.

    The kernel spans ``zeros`` zero crossings of the lower rate under a Hann window, normalised to unit gain at
    0 Hz; inside the band the error is below 1e-3 of the amplitude up to 90 % of the lower Nyquist frequency.
    """
    ratio = fs_new / fs
    cut = min(1.0, ratio)
    reach = int(np.ceil(zeros / cut))
    blocks = with_halo(to_blocks(signals, block, keys), reach, reach, block, keys)

    def one(x, start, left, right):
        x = np.asarray(x, dtype=float)
        own = len(x) - left - right
        total = start + own if right == 0 else None
        lo, hi = int(np.ceil(start * ratio - 1e-9)), int(np.ceil((start + own) * ratio - 1e-9))
        if total is not None:
            hi = min(max(hi, 0), int(round(total * ratio)))
        j = np.arange(lo, hi)
        if not len(j):
            return lo, np.zeros(0)
        ext = sg.odd_extend(x, reach + 1 - left if left < reach + 1 else 0, reach + 1 - right if right < reach + 1 else 0)
        origin = start - left - max(0, reach + 1 - left)
        t = j / ratio - origin
        base = np.floor(t).astype(int)
        idx = base[:, None] + np.arange(-reach + 1, reach + 1)
        d = (t[:, None] - idx) * cut
        w = np.sinc(d) * np.where(np.abs(d) < zeros, 0.5 + 0.5 * np.cos(np.pi * d / zeros), 0.0)
        y = (ext[np.clip(idx, 0, len(ext) - 1)] * w).sum(axis=1) / w.sum(axis=1)
        return lo, y

    @F.pandas_udf("start bigint, samples array<double>")
    def apply(x: pd.Series, start: pd.Series, left: pd.Series, right: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(*row) for row in zip(x, start, left, right)], columns=["start", "samples"])

    out = blocks.select(*keys, apply("samples", "start_sample", "n_left", "n_right").alias("r"))
    return to_samples(out.select(*keys, F.col("r.start").alias("start_sample"), "r.samples"), keys)
