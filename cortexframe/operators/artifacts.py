"""Detection and repair of bad channels and epochs, and cardiac artifacts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spline import spline_weights
from ..plans.blocks import BLOCK_SAMPLES, to_blocks, to_samples, with_halo
from ..plans.chunks import CHUNK, CHUNK_SAMPLES, SERIES, sample_halo
from ..plans.joins import lookup_join, place_join, spread_join
from ..plans.materialize import materialize
from ..plans.quantiles import exact_quantiles
from ..plans.vectors import sum_vectors
from .aggregates import NORMAL_MAD
from .channels import drop_channels, nearest_channels
from .events import keep_spaced
from .filters import butter_blocks
from .ica import correlation_means
from .signals import NEIGHBOR_SAMPLES, neighbor_blocks, window_around_events
from .spectra import welch_psd
from .windows import fixed_epochs, longest_flat_run

EPOCH = ["recording_id", "epoch_idx"]


def flat_channels(signals: DataFrame, fs: float, min_seconds: float = 5.0, threshold: float = 1e-6) -> DataFrame:
    """Channels whose longest run of flat one-second windows reaches ``min_seconds``."""
    runs = longest_flat_run(signals, int(fs), threshold)
    return runs.filter(F.col("longest") >= min_seconds).select(*SERIES)


def mad(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Median absolute deviation on the normal scale, exact for groups of any size."""
    med = exact_quantiles(df, keys, value, {"_med": 0.5})
    dev = spread_join(df, med, keys, "sample_idx").withColumn("_d", F.abs(F.col(value) - F.col("_med")))
    out = exact_quantiles(dev, keys, "_d", {"mad": 0.5})
    return out.withColumn("mad", F.col("mad") / F.lit(NORMAL_MAD))


def channel_robust_z(per_channel: DataFrame, value: str, name: str = "z") -> DataFrame:
    """Robust z over the channels of a recording (a group of one row per channel)."""
    med = per_channel.groupBy("recording_id").agg(F.median(value).alias("_m"))
    d = per_channel.join(med, "recording_id").withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    s = d.groupBy("recording_id").agg((F.median("_d") / F.lit(NORMAL_MAD)).alias("_s"))
    return d.join(s, "recording_id").withColumn(
        name, F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))).drop("_m", "_d", "_s")


def hf_noise(signals: DataFrame, fs: float, high: float = 20.0, low: float = 30.0, block: int = BLOCK_SAMPLES) -> DataFrame:
    """Ratio of the spread above ``high`` to the spread below ``low`` per channel, and its robust z."""
    blocks = materialize(to_blocks(signals, block))
    hp = butter_blocks(blocks, fs, 4, (high, None), block).withColumn("band", F.lit("hp"))
    lp = butter_blocks(blocks, fs, 4, (None, low), block).withColumn("band", F.lit("lp"))
    by_band = [*SERIES, "band"]
    m = mad(to_samples(materialize(hp.unionByName(lp)), by_band), by_band)
    wide = m.groupBy(*SERIES).agg(
        F.max(F.when(F.col("band") == "hp", F.col("mad"))).alias("hp"), F.max(F.when(F.col("band") == "lp", F.col("mad"))).alias("lp"))
    ratio = F.when(F.col("lp") > 0, F.try_divide(F.col("hp"), F.col("lp"))).otherwise(float("inf"))
    return channel_robust_z(wide.select(*SERIES, ratio.alias("ratio")), "ratio")


def hf_noise_channels(signals: DataFrame, fs: float, threshold: float = 4.0, **kw) -> DataFrame:
    return hf_noise(signals, fs, **kw).filter(F.col("z") > threshold).select(*SERIES)


def _min_norm_fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Linear model through a few points: coefficients, then the intercept (minimum norm when underdetermined)."""
    mx, my = x.mean(axis=0), y.mean()
    coef = np.linalg.lstsq(x - mx, y - my, rcond=None)[0]
    return np.append(coef, my - mx @ coef)


# Fixed value: a prime that spreads the numbers of the candidate points over a series.
POINT_STRIDE = 2654435761


def candidate_points(sizes: DataFrame, candidates: int, seed: int) -> DataFrame:
    """``keys, cand, sample_idx`` for ``sizes(keys, n, points)``: the points of every candidate model.

    Point ``p`` of candidate ``c`` is ``(points * c + p + 1 + seed) * POINT_STRIDE`` modulo ``n``.
    """
    every = sizes.withColumn("cand", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1)))).withColumn(
        "_p", F.explode(F.sequence(F.lit(0), F.col("points") - 1)))
    place = (F.col("points") * F.col("cand") + F.col("_p") + 1 + seed).cast("bigint") * F.lit(POINT_STRIDE)
    return every.withColumn("sample_idx", F.pmod(place, F.col("n"))).drop("_p", "n", "points")


def neighbor_correlation(signals: DataFrame, channels: DataFrame, k: int = 3, candidates: int = 20, seed: int = 42) -> DataFrame:
    """|corr| of every positioned channel with its prediction from the ``k`` nearest channels.

    Random-sample consensus on packed stretches. Candidate points have seeded positions, and the stretches that hold them
    hand them over. Then one pass sums, for every candidate, the products of its inliers (residual up to the median absolute
    deviation): the count, the least-squares fit to the winner's inliers and, from the sums over all samples, its
    correlation follow from one vector per series.
    """
    near = nearest_channels(channels, k)

    @F.pandas_udf("at array<bigint>, y array<double>, x array<double>")
    def complete(parts: pd.Series) -> pd.DataFrame:
        """Samples that a channel and all its neighbours have, neighbours in the rows of a flat matrix of ``k`` columns."""
        out = []
        for p in parts:
            at = np.asarray(p[0]["at"])
            for q in p[1:]:
                there = np.asarray(q["at"])
                if len(there) != len(at) or (there != at).any():
                    at = np.intersect1d(at, there, assume_unique=True)
            own = [np.asarray(q["v"], float)[np.searchsorted(np.asarray(q["at"]), at)] for q in p]
            x = np.zeros((len(at), k))
            for i, v in enumerate(own[1:]):
                x[:, i] = v
            ok = np.isfinite(x).all(axis=1) & np.isfinite(own[0])
            out.append((at[ok], own[0][ok], x[ok].ravel()))
        return pd.DataFrame(out, columns=["at", "y", "x"])

    blocks = neighbor_blocks(signals, near).filter(F.size("parts") == F.col("k") + 1)
    data = materialize(blocks.select(*SERIES, "block_idx", "k", complete("parts").alias("_d")).select(*SERIES, "block_idx", "k", "_d.*"))
    data = data.filter(F.size("y") > 0)
    y = data.select(*SERIES, "block_idx", F.explode("y").alias("value"))
    med = exact_quantiles(y, SERIES, "value", {"_med": 0.5})
    dev = spread_join(y, med, SERIES, "block_idx").withColumn("_d", F.abs(F.col("value") - F.col("_med")))
    limit = exact_quantiles(dev, SERIES, "_d", {"_limit": 0.5})

    sizes = data.groupBy(*SERIES).agg(
        (F.max(F.element_at("at", -1)) + 1).alias("n"), F.least(F.max("k"), F.lit(3)).alias("points"))
    wanted = candidate_points(sizes, candidates, seed).groupBy(
        *SERIES, F.floor(F.col("sample_idx") / NEIGHBOR_SAMPLES).cast("bigint").alias("block_idx")
    ).agg(F.collect_list(F.struct("cand", "sample_idx")).alias("_w"))

    @F.pandas_udf("array<struct<cand:int,sample_idx:bigint,y:double,x:array<double>>>")
    def fetch(at: pd.Series, y: pd.Series, x: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for a, v, m, points in zip(at, y, x, w):
            a, m, rows = np.asarray(a), np.reshape(m, (-1, k)), []
            for p in points:
                i = int(np.searchsorted(a, p["sample_idx"]))
                if i < len(a) and a[i] == p["sample_idx"]:
                    rows.append({"cand": p["cand"], "sample_idx": p["sample_idx"], "y": float(v[i]), "x": m[i].tolist()})
            out.append(rows)
        return pd.Series(out, dtype=object)

    @F.pandas_udf("models array<double>, shift array<double>")
    def solve(points: pd.Series) -> pd.DataFrame:
        out = []
        for p in points:  # the at most 3 points of every candidate
            cand, ys, xs = np.array([q["cand"] for q in p]), np.array([q["y"] for q in p]), np.array([q["x"] for q in p])
            fit = np.full((candidates, k + 1), np.nan)
            for c in set(cand.tolist()):
                fit[c] = _min_norm_fit(xs[cand == c], ys[cand == c])
            out.append((fit.ravel(), np.append(xs.mean(axis=0), ys.mean())))
        return pd.DataFrame(out, columns=["models", "shift"])

    found = place_join(data, wanted, [*SERIES, "block_idx"], "inner").select(*SERIES, F.explode(fetch("at", "y", "x", "_w")).alias("p"))
    packed = found.groupBy(*SERIES).agg(F.array_sort(F.collect_list("p")).alias("p"))
    models = packed.select(*SERIES, solve("p").alias("_m")).select(*SERIES, "_m.*").join(limit, SERIES)
    up = np.triu_indices(k + 2)

    @F.pandas_udf("array<double>")
    def products(frame: pd.DataFrame) -> pd.Series:
        """Sums of the products of ``[1, x, y]`` over the inliers of every candidate, then over all samples."""
        out = []
        for y, x, fit, shift, most in zip(*(frame[c] for c in ("y", "x", "models", "shift", "_limit"))):
            y, x, fit = np.asarray(y), np.reshape(x, (-1, k)), np.reshape(fit, (candidates, k + 1))
            inlier = np.abs(y[:, None] - (x @ fit[:, :k].T + fit[:, k])) <= most
            z = np.column_stack((np.ones(len(y)), x - shift[:k], y - shift[k]))
            z = z[:, up[0]] * z[:, up[1]]
            out.append(np.concatenate(((inlier.T.astype(float) @ z).ravel(), z.sum(axis=0))))
        return pd.Series(out, dtype=object)

    @F.pandas_udf("double")
    def judge(sums: pd.Series) -> pd.Series:
        out = []
        for s in sums:
            full = np.zeros((candidates + 1, k + 2, k + 2))
            full[:, up[0], up[1]] = full[:, up[1], up[0]] = np.reshape(s, (candidates + 1, -1))
            best = full[int(np.argmax(full[:candidates, 0, 0]))]
            coef = np.linalg.lstsq(best[:k + 1, :k + 1], best[:k + 1, k + 1], rcond=None)[0][1:]
            n, mean = full[-1, 0, 0], full[-1, 0, 1:] / full[-1, 0, 0]
            cov = full[-1, 1:, 1:] / n - np.outer(mean, mean)
            spread = (coef @ cov[:k, :k] @ coef) * cov[k, k]
            out.append(abs(coef @ cov[:k, k]) / np.sqrt(spread) if spread > 0 else 0.0)
        return pd.Series(out)

    met = spread_join(data, models, SERIES, "block_idx")
    sums = sum_vectors(met.select(*SERIES, products(F.struct("y", "x", "models", "shift", "_limit")).alias("s")), SERIES, "s")
    return sums.select(*SERIES, judge("s").alias("corr"))


def low_corr_channels(signals: DataFrame, channels: DataFrame, threshold: float = 0.8, **kw) -> DataFrame:
    """Channels that their neighbours do not predict; a channel without a position counts as 0.

    A recording with fewer than two positioned channels yields none.
    """
    corr = neighbor_correlation(signals, channels, **kw)
    norm = F.sqrt(sum(F.col(f"pos.{c}") ** 2 for c in "xyz"))
    usable = channels.groupBy("recording_id").agg(
        F.count_if(F.col("pos").isNotNull() & ~F.isnan(norm) & (norm > 1e-6)).alias("_v")).filter("_v >= 2")
    rated = channels.join(usable, "recording_id").join(corr, SERIES, "left").withColumn("corr", F.coalesce("corr", F.lit(0.0)))
    return rated.filter(F.col("corr") < threshold).select(*SERIES)


def bad_channels(*parts: DataFrame) -> DataFrame:
    """Union of several bad-channel lists without repeats."""
    out = parts[0].select(*SERIES)
    for p in parts[1:]:
        out = out.unionByName(p.select(*SERIES))
    return out.distinct()


def _zscores(df: DataFrame, keys: list[str], metrics: list[str], bounded: bool = False) -> DataFrame:
    """Columns ``z_<metric>`` over the rows of each key (population std)."""
    if bounded:
        w = Window.partitionBy(*keys)
        z = [F.try_divide(F.col(m) - F.avg(m).over(w), F.stddev_pop(m).over(w)).alias(f"z_{m}") for m in metrics]
        return df.select("*", *z)
    stats = df.groupBy(*keys).agg(*[F.avg(m).alias(f"_a_{m}") for m in metrics], *[F.stddev_pop(m).alias(f"_s_{m}") for m in metrics])
    out = spread_join(df, stats, keys, F.xxhash64(*df.columns))
    z = [F.try_divide(F.col(m) - F.col(f"_a_{m}"), F.col(f"_s_{m}")).alias(f"z_{m}") for m in metrics]
    return out.select(*df.columns, *z)


def _outlier(metrics: list[str], threshold: float):
    cond = F.lit(False)
    for m in metrics:
        cond = cond | (F.abs(F.coalesce(F.col(f"z_{m}"), F.lit(0.0))) > threshold)
    return cond


def hurst(signals: DataFrame, chunk: int = CHUNK_SAMPLES) -> DataFrame:
    """Hurst exponent per channel from second differences at spacing one and two."""
    halo = sample_halo(signals, 4, 0, chunk)
    w = Window.partitionBy(*SERIES, CHUNK).orderBy("sample_idx")
    x = F.col("value")
    lag = lambda n: F.lag("value", n).over(w)
    size = signals.groupBy(*SERIES).agg(F.max("sample_idx").alias("_last"))
    d = halo.withColumn("_d1", x - 2 * lag(1) + lag(2)).withColumn("_d2", x - 2 * lag(2) + lag(4)).filter("_own")
    d = spread_join(d, size, SERIES, "sample_idx").filter(F.col("sample_idx") < F.col("_last"))
    s1 = F.avg(F.when(F.col("sample_idx") >= 3, F.col("_d1") ** 2))
    s2 = F.avg(F.when(F.col("sample_idx") >= 5, F.col("_d2") ** 2))
    return d.groupBy(*SERIES).agg((0.5 * F.log2(F.try_divide(s2, s1))).alias("hurst"))


def channel_metrics(signals: DataFrame, fs: float, nperseg: int, line: tuple[float, ...] = (50.0, 60.0)) -> DataFrame:
    """Variance, mean correlation with the other channels, Hurst exponent, kurtosis and mains power per channel."""
    base = signals.groupBy(*SERIES).agg(F.var_pop("value").alias("variance"), F.kurtosis("value").alias("kurtosis"))
    out = base.join(correlation_means(signals), SERIES).join(hurst(signals), SERIES)
    psd = welch_psd(signals, fs, nperseg, fmax=fs / 2)
    res = fs / nperseg
    near = F.lit(False)
    for f in line:
        near = near | (F.abs(F.col("freq") - f) <= res / 2)
    mains = psd.filter(near).groupBy(*SERIES).agg(F.sum("power").alias("line_noise"))
    return out.join(mains, SERIES, "left").withColumn("line_noise", F.coalesce("line_noise", F.lit(0.0)))


CHANNEL_METRICS = ["variance", "correlation", "hurst", "kurtosis", "line_noise"]


def faster_channels(signals: DataFrame, fs: float, nperseg: int, threshold: float = 3.0) -> DataFrame:
    """Channels that stand out over the channels of their recording in any metric."""
    z = _zscores(channel_metrics(signals, fs, nperseg), ["recording_id"], CHANNEL_METRICS, bounded=True)
    return z.withColumn("is_bad", _outlier(CHANNEL_METRICS, threshold))


def epoch_channel_stats(epochs: DataFrame) -> DataFrame:
    """Range, variance, mean and median absolute step of every epoch and channel."""
    w = Window.partitionBy(*EPOCH, "channel").orderBy("offset")  # one epoch of one channel
    step = epochs.withColumn("_g", F.abs(F.col("value") - F.lag("value").over(w)))
    return step.groupBy(*EPOCH, "channel").agg(
        (F.max("value") - F.min("value")).alias("amplitude"), F.var_pop("value").alias("variance"),
        F.avg("value").alias("mean"), F.median("_g").alias("median_gradient"))


def _with_deviation(stats: DataFrame) -> DataFrame:
    """Epoch mean minus the mean of the channel's epoch means."""
    overall = stats.groupBy(*SERIES).agg(F.avg("mean").alias("_cm"))
    return spread_join(stats, overall, SERIES, "epoch_idx").withColumn("deviation", F.col("mean") - F.col("_cm")).drop("_cm")


def faster_epochs(epochs: DataFrame, threshold: float = 5.0, stats: DataFrame | None = None) -> DataFrame:
    """Epochs that stand out over the epochs of their recording in mean range, variance or deviation.

    ``stats`` takes the stored result of ``epoch_channel_stats``.
    """
    s = _with_deviation(stats if stats is not None else epoch_channel_stats(epochs))
    metrics = ["amplitude", "variance", "deviation"]
    per = s.groupBy(*EPOCH).agg(*[F.avg(m).alias(m) for m in metrics])
    return _zscores(per, ["recording_id"], metrics).withColumn("is_bad", _outlier(metrics, threshold))


def faster_channels_in_epochs(epochs: DataFrame, threshold: float = 3.0, stats: DataFrame | None = None) -> DataFrame:
    """Channels that stand out over the channels of one epoch."""
    s = _with_deviation(stats if stats is not None else epoch_channel_stats(epochs))
    metrics = ["amplitude", "variance", "deviation", "median_gradient"]
    return _zscores(s, EPOCH, metrics, bounded=True).withColumn("is_bad", _outlier(metrics, threshold))


def _policy_table(epochs: DataFrame, global_bads: DataFrame) -> DataFrame:
    """Epoch rows ``(recording_id, epoch_idx, is_bad, bad_channels)`` with the recording's global bad list."""
    g = global_bads.groupBy("recording_id").agg(F.array_sort(F.collect_set("channel")).alias("global_bads"))
    out = lookup_join(epochs, g, ["recording_id"], "left")
    empty = F.array().cast("array<string>")
    return out.withColumn("global_bads", F.coalesce("global_bads", empty)).withColumn(
        "all_bads", F.array_sort(F.array_union("bad_channels", "global_bads")))


def epoch_policy(epochs: DataFrame, global_bads: DataFrame, n_channels: int | Column, max_frac: float = 0.2) -> DataFrame:
    """``marked_bad`` when the epoch is bad or too many channels are; ``repaired`` with own bad channels; else ``none``."""
    t = _policy_table(epochs, global_bads).withColumn("bad_ratio", F.size("all_bads") / n_channels)
    own = F.size("bad_channels") > 0
    marked = F.col("is_bad") | (F.col("bad_ratio") > max_frac)
    return t.withColumn("action", F.when(marked, "marked_bad").when(own, "repaired").otherwise("none")).withColumn(
        "repaired_channels", F.when(~marked & own, F.col("bad_channels")).otherwise(F.array().cast("array<string>")))


def epoch_policy_stim(epochs: DataFrame) -> DataFrame:
    """Stimulation epochs stay; other bad epochs are repaired when more than one channel is bad."""
    fix = ~F.col("is_stim") & F.col("is_bad") & (F.size("bad_channels") > 1)
    return epochs.withColumn("action", F.when(fix, "repaired").otherwise("none"))


def epoch_policy_v2(epochs: DataFrame, global_bads: DataFrame, n_channels: int | Column, max_frac: float = 0.2) -> DataFrame:
    """Bad epochs with too many own bad channels are candidates; they are interpolated when the joint list
    exceeds 30 % of the channels."""
    t = _policy_table(epochs, global_bads)
    cand = F.col("is_bad") & (F.size("bad_channels") / n_channels > max_frac)
    big = F.size("all_bads") > 0.3 * n_channels
    return t.withColumn("action", F.when(cand & big, "interpolated").when(cand, "candidate").otherwise("none"))


def interpolate(frames: DataFrame, channels: list[str], positions: dict[str, tuple[float, float, float]], bads: str = "bads",
                absent: str | None = None) -> DataFrame:
    """Replace the channels listed in column ``bads`` of every frame by spherical-spline predictions.

    Weights depend only on the two channel lists of a frame, so each task computes them once per pair it meets. Only frames
    with a list are handed to Python; in all frames a value that is not a number becomes null.
    Channels without a position, and those listed in column ``absent``, are neither used nor repaired.
    """
    index = {c: i for i, c in enumerate(channels)}
    placed = [i for i, c in enumerate(channels) if c in positions and np.linalg.norm(positions[c]) > 1e-6]
    xyz = np.array([positions.get(c, (0.0, 0.0, 0.0)) for c in channels], dtype=float)

    def listed(names) -> tuple[int, ...]:
        return tuple(sorted(index[n] for n in names if n in index)) if names is not None else ()

    @F.pandas_udf("array<double>")
    def repair(values: pd.Series, bad: pd.Series, gone: pd.Series) -> pd.Series:
        out = list(values)
        groups: dict[tuple, list[int]] = {}
        for row, names in enumerate(zip(bad, gone)):
            if names[0] is not None and out[row] is not None:
                groups.setdefault(tuple(map(listed, names)), []).append(row)
        for (key, off), rows in groups.items():
            wrong = [i for i in key if i in placed and i not in off]
            good = [i for i in placed if i not in key and i not in off]
            if not wrong or not good:
                continue
            w = spline_weights(xyz[good], xyz[wrong])
            x = np.stack([np.array(out[r], dtype=float) for r in rows])
            x[:, wrong] = x[:, good] @ w.T
            for r, v in zip(rows, x):
                out[r] = v
        return pd.Series(out, dtype=object)

    gone = F.col(absent) if absent else F.lit(None).cast("array<string>")
    asked = F.coalesce(F.size(bads) > 0, F.lit(False))
    fixed = repair(*[F.when(asked, c) for c in (F.col("values"), F.col(bads), gone)])
    kept = F.when(F.exists("values", F.isnan), F.transform("values", lambda v: F.when(~F.isnan(v), v))).otherwise(F.col("values"))
    return frames.withColumn("values", F.when(asked, fixed).otherwise(kept))


def detect_r_peaks(ecg: DataFrame, fs: float, block: int = BLOCK_SAMPLES) -> DataFrame:
    """Beat positions ``(recording_id, peak_idx)`` of an ECG series.

    High-pass at 0.5 Hz, absolute gradient smoothed over 0.1 s against 1.5 times its 0.75 s mean; the maximum
    inside each excursion of at least 0.04 s is a beat; beats keep 0.3 s distance. Excursions are found per
    haloed block and owned by the block that holds their first sample.
    """
    keys = ["recording_id"]
    clean = butter_blocks(materialize(to_blocks(ecg, block, keys)), fs, 5, (0.5, None), block, keys)
    halo = int(4 * fs)
    blocks = with_halo(clean, halo, halo, block, keys)
    short, wide, least = max(1, int(round(0.1 * fs))), max(1, int(round(0.75 * fs))), max(1, int(0.04 * fs))

    def box(v, n):
        return np.convolve(np.pad(v, (n // 2, n - 1 - n // 2), mode="edge"), np.ones(n) / n, mode="valid")

    def one(x, start, left, right):
        x = np.asarray(x, dtype=float)
        if len(x) < 3:
            return []
        grad = box(np.abs(np.gradient(x)), short)
        on = grad > 1.5 * box(grad, wide)
        edge = np.diff(np.concatenate([[0], on.astype(int), [0]]))
        out = []
        for b, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            if left <= b < len(x) - right and e - b >= least:
                out.append(int(start - left + b + int(np.argmax(x[b:e]))))
        return out

    @F.pandas_udf("array<bigint>")
    def beats(x: pd.Series, start: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([one(*row) for row in zip(x, start, left, right)], dtype=object)

    raw = blocks.select(*keys, F.explode(beats("samples", "start_sample", "n_left", "n_right")).alias("peak_idx")).distinct()
    return keep_spaced(raw, keys, "peak_idx", 0.3 * fs)


def ecg_template(signals: DataFrame, peaks: DataFrame, pre: int, post: int) -> DataFrame:
    """Median beat per channel and offset; exact for any number of beats."""
    win = window_around_events(signals, peaks, pre, post)
    return exact_quantiles(win, [*SERIES, "offset"], "value", {"template": 0.5})


def subtract_template(signals: DataFrame, peaks: DataFrame, pre: int, post: int, ecg_channels: list[str] = ()) -> DataFrame:
    """Subtract the channel's median beat at every beat; overlapping beats subtract repeatedly.

    ECG channels and recordings without beats stay as they are.
    """
    target = signals.filter(~F.col("channel").isin(list(ecg_channels))) if ecg_channels else signals
    win = window_around_events(target, peaks, pre, post)
    tpl = exact_quantiles(win, [*SERIES, "offset"], "value", {"template": 0.5})
    hit = spread_join(win.select(*SERIES, "sample_idx", "offset"), tpl, [*SERIES, "offset"], "sample_idx")
    total = hit.groupBy(*SERIES, "sample_idx").agg(F.sum("template").alias("_t"))
    out = signals.join(total, [*SERIES, "sample_idx"], "left")
    return out.withColumn("value", F.col("value") - F.coalesce("_t", F.lit(0.0))).select(*signals.columns)


def detect_bad_channels(signals: DataFrame, channels: DataFrame, fs: float, corr_threshold: float = 0.8,
                        noise_z: float = 4.0, **bands) -> DataFrame:
    """Flat, noisy or uncorrelated EEG channels; ``bands`` are the cut-offs of ``hf_noise``."""
    eeg = channels.filter("ch_type = 'eeg'")
    s = lookup_join(signals, eeg.select(*SERIES), SERIES)
    return bad_channels(flat_channels(s, fs), hf_noise_channels(s, fs, noise_z, **bands), low_corr_channels(s, eeg, corr_threshold))


def epoch_review(signals: DataFrame, fs: float, length: float = 1.0, epoch_threshold: float = 5.0,
                 channel_threshold: float = 3.0, stim: DataFrame | None = None, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """Epoch table ``(is_bad, bad_channels[, is_stim])`` and the bad channels of whole recordings.

    Those are bad in too many epochs or, without stimulation and if ``whole``, stand out over the channels of the recording.
    """
    ep = fixed_epochs(signals, length, fs)
    rate, judged = 0.3, ep
    if stim is not None:
        from .events import flag_epochs

        flags = flag_epochs(ep.select(*EPOCH).distinct(), stim, length, fs)
        judged = ep.join(flags.filter(~F.col("is_stim")).select(*EPOCH), EPOCH, "left_semi")
        rate = 0.2
    stats = materialize(epoch_channel_stats(judged))  # one row per epoch and channel, used by both tests
    bad_ep = faster_epochs(judged, epoch_threshold, stats).select(*EPOCH, "is_bad")
    bad_ch = faster_channels_in_epochs(judged, channel_threshold, stats).filter("is_bad").select(*EPOCH, "channel")
    lists = bad_ch.groupBy(*EPOCH).agg(F.array_sort(F.collect_set("channel")).alias("bad_channels"))
    table = bad_ep.join(lists, EPOCH, "left").withColumn(
        "bad_channels", F.coalesce("bad_channels", F.array().cast("array<string>")))
    n = bad_ep.groupBy("recording_id").agg(F.count(F.lit(1)).alias("_n"))
    often = bad_ch.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_b")).join(n, "recording_id").filter(
        F.col("_b") / F.col("_n") > rate).select(*SERIES)
    if stim is None and whole:
        often = bad_channels(often, faster_channels(signals, fs, int(length * fs), channel_threshold).filter("is_bad"))
    if stim is not None:
        rest = flags.join(table, EPOCH, "left")
        table = rest.withColumn("is_bad", F.coalesce("is_bad", F.lit(False))).withColumn(
            "bad_channels", F.coalesce("bad_channels", F.array().cast("array<string>")))
    return table, often


def remove_bad(signals: DataFrame, bads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good part and bad part of the signals."""
    good = drop_channels(signals, bads)
    bad = lookup_join(signals, bads.select(*SERIES).distinct(), SERIES)
    return good, bad
