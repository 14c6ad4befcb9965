"""Channel covariance and independent components on frames ``(recording_id, sample_idx, values)``.

Only channel-by-channel matrices leave the executors: tasks add up their own rows and emit one matrix each.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.chunks import SERIES
from ..plans.joins import spread_join
from ..plans.materialize import materialize
from ..plans.vectors import sum_vectors

# Component classes that count as artifacts.
ARTIFACT_TYPES = ["eye blink", "muscle artifact", "heart beat", "line noise", "channel noise"]


def correlation_means(signals: DataFrame) -> DataFrame:
    """Mean correlation of every channel with the other channels of its recording.

    With z-scores, the mean over the others is ``(mean(z * S) - 1) / (c - 1)`` where ``S`` sums the channels of
    a sample, so no channel pairs are formed.
    """
    stats = signals.groupBy(*SERIES).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    z = spread_join(signals, stats, SERIES, "sample_idx").select(
        *SERIES, "sample_idx", F.try_divide(F.col("value") - F.col("_m"), F.col("_s")).alias("_z"))
    w = Window.partitionBy("recording_id", "sample_idx")  # the channels of one sample
    s = z.withColumn("_all", F.sum("_z").over(w)).withColumn("_c", F.count("_z").over(w))
    agg = s.groupBy(*SERIES).agg(F.avg(F.col("_z") * F.col("_all")).alias("_p"), F.max("_c").alias("_c"))
    return agg.select(*SERIES, F.try_divide(F.col("_p") - 1, F.col("_c") - 1).alias("correlation"))


def moments(frames: DataFrame, n_ch: int, keys: list[str] = []) -> DataFrame:
    """``keys, s``: the flattened ``(n_ch + 1)**2`` Gram matrix of ``[1, x]``; tasks send one vector per key."""
    def add(batches):
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for key, part in (b.groupby(keys, sort=False) if keys else [((), b)]):
                x = np.stack(part["values"].to_numpy()) if len(part) else np.zeros((0, n_ch))
                x = np.hstack([np.ones((len(x), 1)), x])
                key = key if isinstance(key, tuple) else (key,)
                sums[key] = sums.get(key, 0) + x.T @ x
        yield pd.DataFrame([(*k, s.ravel()) for k, s in sums.items()], columns=[*keys, "s"])

    schema = ", ".join([*[f"{k} string" for k in keys], "s array<double>"])
    return sum_vectors(frames.select(*keys, "values").mapInPandas(add, schema), keys, "s")


def gram(frames: DataFrame, n_ch: int) -> DataFrame:
    """Gram matrix of the channels per recording: ``recording_id, i, j, value``."""
    m = moments(frames, n_ch, ["recording_id"]).select("recording_id", F.posexplode("s").alias("i", "v"))
    i, j = F.floor(F.col("i") / (n_ch + 1)), F.col("i") % (n_ch + 1)
    return m.filter((i > 0) & (j > 0)).select(
        "recording_id", (i - 1).cast("bigint").alias("i"), (j - 1).cast("bigint").alias("j"), F.col("v").alias("value"))


def covariance(frames: DataFrame, n_ch: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean vector, covariance matrix and row count over all frames."""
    return _central(np.asarray(moments(frames, n_ch).first()["s"], float).reshape(n_ch + 1, n_ch + 1))


def _central(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    n = int(g[0, 0])
    mean = g[0, 1:] / n
    return mean, g[1:, 1:] / n - np.outer(mean, mean), n


def whitening(g: np.ndarray, variance: float | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, whitening matrix of the leading components and row count from the Gram matrix of ``[1, x]``."""
    mean, cov, n = _central(g)
    vals, vecs = np.linalg.eigh(cov)
    vals, vecs = vals[::-1], vecs[:, ::-1]
    k = int((vals > vals[0] * 1e-12).sum()) if vals[0] > 0 else 0
    if variance is not None and k:
        share = np.cumsum(vals) / vals.sum()
        k = min(k, int((share <= variance).sum()) + 1)
    return mean, (vecs[:, :k] / np.sqrt(vals[:k])).T, n


def decorrelate(w: np.ndarray) -> np.ndarray:
    """Also for a stack of matrices."""
    vals, vecs = np.linalg.eigh(w @ w.swapaxes(-1, -2))
    return (vecs * (1 / np.sqrt(np.maximum(vals, 1e-300)))[..., None, :]) @ vecs.swapaxes(-1, -2) @ w


def contrast(z: np.ndarray, w: np.ndarray, method: str) -> tuple[np.ndarray, np.ndarray]:
    """What a step needs from the whitened frames ``z``, as sums over them; also for stacks of frames and unmixing rows."""
    y = z @ w.swapaxes(-1, -2)
    if method == "fastica":
        t = np.tanh(y)
        return t.swapaxes(-1, -2) @ z, (1 - t**2).sum(axis=-2)
    return np.tanh(y / 2).swapaxes(-1, -2) @ y, np.zeros(w.shape[:-1])


def next_unmixing(w: np.ndarray, s: np.ndarray, d: np.ndarray, last: np.ndarray, rate: np.ndarray, method: str):
    """The next unmixing rows from the means of ``contrast``, the change, its rate and how far the rows moved, for a stack.

    ``fastica`` is the fixed point. ``infomax`` follows the natural gradient; a change that turns by more than 60 degrees from
    the ``last`` one lowers the rate.
    """
    if method == "fastica":
        new = decorrelate(s - d[..., None] * w)
        return new, last, rate, np.abs(np.abs((new * w).sum(axis=-1)) - 1).max(axis=-1)
    change = (np.eye(w.shape[-1]) - s) @ w
    length = np.sqrt((change**2).sum(axis=(-1, -2)) * (last**2).sum(axis=(-1, -2)))
    rate = np.where((change * last).sum(axis=(-1, -2)) < 0.5 * length, 0.9 * rate, rate)
    new = w + rate[..., None, None] * change
    return new, change, rate, np.abs(new - w).max(axis=(-1, -2))


@dataclass(frozen=True)
class IcaModel:
    mean: np.ndarray
    unmixing: np.ndarray  # components x channels
    mixing: np.ndarray  # channels x components
    iterations: int
    converged: bool


def ica_fit(frames: DataFrame, n_ch: int, variance: float | None = 0.99, seed: int = 42, method: str = "fastica",
            max_iter: int = 200, tol: float = 1e-4) -> IcaModel:
    """Independent components of the frames.

    Whitening uses the covariance matrix; ``variance`` keeps the leading components that explain this share
    (None keeps all). Every fixed-point step (``fastica``) or natural-gradient step (``infomax``) is one job
    that sums ``g(W x) x'`` over the stored frames. A fit that ends at ``max_iter`` warns and says so in the model.
    """
    mean, white, n = whitening(np.asarray(moments(frames, n_ch).first()["s"], float).reshape(n_ch + 1, n_ch + 1), variance)
    k = len(white)
    stored = materialize(frames.select("values"))
    w = decorrelate(np.random.default_rng(seed).standard_normal((k, k)))
    rate = 0.5

    def pass_over(w):
        def add(batches):
            s, d = np.zeros((k, k)), np.zeros(k)
            for b in batches:
                if not len(b):
                    continue
                z = (np.stack(b["values"].to_numpy()) - mean) @ white.T
                y = z @ w.T
                if method == "fastica":
                    t = np.tanh(y)
                    s += t.T @ z
                    d += (1 - t**2).sum(axis=0)
                else:
                    s += np.tanh(y / 2).T @ y
            yield pd.DataFrame({"s": [np.concatenate([s.ravel(), d])]})

        out = np.asarray(sum_vectors(stored.mapInPandas(add, "s array<double>"), [], "s").first()["s"], float)
        return out[: k * k].reshape(k, k) / n, out[k * k:] / n

    step, moved = 0, np.inf
    for step in range(1, max_iter + 1):
        s, d = pass_over(w)
        if method == "fastica":
            new = decorrelate(s - d[:, None] * w)
            moved = np.max(np.abs(np.abs(np.diag(new @ w.T)) - 1))
        else:
            new = w + rate * (np.eye(k) - s) @ w
            moved = np.max(np.abs(new - w))
        w = new
        if moved < tol:
            break
    unmixing = w @ white
    if moved >= tol:
        warnings.warn(f"components moved by {moved:.2g} in the last of {step} steps, not below {tol}")
    return IcaModel(mean, unmixing, np.linalg.pinv(unmixing), step, bool(moved < tol))


def select_components(labels: DataFrame, rule: str = "artifact") -> DataFrame:
    """Components to remove from a table ``(component, label, proba)``.

    ``artifact``: an artifact class above 0.5; ``non_brain``: any class but brain above 0.7; ``non_brain_60``:
    the same above 0.6.
    """
    if rule == "artifact":
        cond = F.col("label").isin(ARTIFACT_TYPES) & (F.col("proba") > 0.5)
    else:
        cond = (F.col("label") != "brain") & (F.col("proba") > {"non_brain": 0.7, "non_brain_60": 0.6}[rule])
    return labels.filter(cond)


def ica_apply(frames: DataFrame, model: IcaModel, exclude: list[int] | str) -> DataFrame:
    """Subtract components from every frame.

    ``exclude`` is one list for all frames or the name of an integer array column: with a column, segments can
    drop different components and stimulation frames (empty list) stay untouched.
    """
    mean, un, mix = model.mean, model.unmixing, model.mixing
    col = F.col(exclude) if isinstance(exclude, str) else F.array(*[F.lit(int(e)) for e in exclude]).cast("array<int>")

    @F.pandas_udf("array<double>")
    def clean(values: pd.Series, drop: pd.Series) -> pd.Series:
        out = list(values)
        groups: dict[tuple, list[int]] = {}
        for row, d in enumerate(drop):
            groups.setdefault(tuple(int(c) for c in d) if d is not None else (), []).append(row)
        for key, rows in groups.items():
            if not key:
                continue
            x = np.stack([np.asarray(out[r], dtype=float) for r in rows])
            x = x - (x - mean) @ un[list(key)].T @ mix[:, list(key)].T
            for r, v in zip(rows, x):
                out[r] = v
        return pd.Series(out, dtype=object)

    return frames.withColumn("values", clean("values", col))


def segment_excludes(frames: DataFrame, labels: DataFrame, fs: float, seconds: float = 600.0, rule: str = "non_brain") -> DataFrame:
    """Attach the components to drop in each segment of ``seconds`` as array column ``exclude``."""
    lists = select_components(labels, rule).groupBy("recording_id", "segment_idx").agg(
        F.array_sort(F.collect_set(F.col("component").cast("int"))).alias("exclude"))
    seg = frames.withColumn("segment_idx", F.floor(F.col("sample_idx") / F.lit(seconds * fs)).cast("bigint"))
    out = spread_join(seg, lists, ["recording_id", "segment_idx"], "sample_idx", "left")
    return out.withColumn("exclude", F.coalesce("exclude", F.array().cast("array<int>")))
