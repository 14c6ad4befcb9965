"""Independent components of many stretches at once: one model per key, no job per key.

Models are rows of a table. Keys whose frames are few, such as windows, take all their steps in the task that gathers them. For
the others a step is one job: it joins the models with matrix blocks of frames, every block adds its part of the sums, and the
sums of a key become its next model on an executor. Keys that have settled drop out. Nothing of a key is on the driver.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import MAX_BROADCAST_BYTES, lookup_join, spread_join
from ..plans.materialize import drop_table, materialize
from ..plans.size import memory_bytes
from ..plans.vectors import sum_vectors
from .ica import contrast, decorrelate, next_unmixing, whitening

FRAMES_PER_BLOCK = 1024
WHOLE_VALUES = 1 << 17  # up to here (1 MB) the frames of a key are gathered in one row
STACK_VALUES = 1 << 20  # values of the frames that take a step at once
STEPS = {"fastica": 200, "infomax": 2000}


def pack_frames(frames: DataFrame, keys: list[str], rows: int = FRAMES_PER_BLOCK) -> DataFrame:
    """``keys, _block, x``: up to ``rows`` consecutive frames as one flat matrix."""
    block = F.floor(F.col("sample_idx") / rows).cast("bigint").alias("_block")
    packed = frames.groupBy(*keys, block).agg(F.array_sort(F.collect_list(F.struct("sample_idx", "values"))).alias("_f"))
    return packed.select(*keys, "_block", F.flatten(F.transform("_f", lambda f: f["values"])).alias("x"))


def keyed_moments(blocks: DataFrame, n_ch: int, keys: list[str]) -> DataFrame:
    """``keys, moments``: the flat Gram matrix of ``[1, x]`` over all frames of a key."""

    @F.pandas_udf("array<double>")
    def gram(x: pd.Series) -> pd.Series:
        out = []
        for flat in x:
            m = np.asarray(flat, float).reshape(-1, n_ch)
            m = np.hstack([np.ones((len(m), 1)), m])
            out.append((m.T @ m).ravel())
        return pd.Series(out, dtype=object)

    return sum_vectors(blocks.select(*keys, gram("x").alias("moments")), keys, "moments")


def begin(k: int, seed: int, count: int = 1) -> tuple[np.ndarray, ...]:
    """Unmixing rows, last change, rate, steps and whether there is nothing to settle, of ``count`` models."""
    w = decorrelate(np.random.default_rng(seed).standard_normal((k, k))) if k else np.zeros((0, 0))
    return np.repeat(w[None], count, axis=0), np.zeros((count, k, k)), np.full(count, 0.5), np.zeros(count, int), np.full(count, k == 0)


def _components(w: np.ndarray, white: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unmixing and mixing matrix."""
    un = w @ white
    return un, np.linalg.pinv(un) if len(un) else un.T


def fit_together(frames: list[np.ndarray], variance: float | None, seed: int, method: str, max_iter: int, tol: float) -> list[tuple]:
    """``k, mean, unmixing, mixing, iterations, converged`` of each matrix of frames; matrices of one shape take their steps at once."""
    out: list = [None] * len(frames)
    alike: dict[tuple, list[tuple]] = {}
    for i, x in enumerate(frames):
        m = np.hstack([np.ones((len(x), 1)), x])
        mean, white, n = whitening(m.T @ m, variance)
        alike.setdefault((n, len(white)), []).append((i, mean, white))
    for (n, k), members in alike.items():
        size = max(1, STACK_VALUES // max(1, n * k))
        for part in (members[a:a + size] for a in range(0, len(members), size)):
            w, last, rate, steps, settled = begin(k, seed, len(part))
            at = np.flatnonzero(~settled)
            z = np.stack([(frames[i] - mean) @ white.T for i, mean, white in part])
            for step in range(1, max_iter + 1):
                if not len(at):
                    break
                s, d = contrast(z, w[at], method)
                w[at], last[at], rate[at], moved = next_unmixing(w[at], s / n, d / n, last[at], rate[at], method)
                steps[at] = step
                still = ~(moved < tol)
                if not still.all():
                    settled[at[~still]], at, z = True, at[still], z[still]
            for (i, mean, white), *model in zip(part, w, steps, settled):
                out[i] = (k, mean, *(m.ravel() for m in _components(model[0], white)), int(model[1]), bool(model[2]))
    return out


def ica_fit_keyed(frames: DataFrame, n_ch: int, keys: list[str], variance: float | None = 0.99, seed: int = 42,
                  max_iter: int | None = None, tol: float = 1e-4, method: str = "fastica") -> DataFrame:
    """``keys, k, mean, unmixing, mixing, iterations, converged`` of every key, equal to a fit of its frames alone.

    Matrices are flat arrays: ``unmixing`` has ``k`` rows of ``n_ch``, ``mixing`` ``n_ch`` rows of ``k``. A key without
    variance has ``k = 0``. ``method`` is ``fastica`` or ``infomax``.
    """
    max_iter = max_iter or STEPS[method]
    blocks = materialize(pack_frames(frames, keys))
    sizes = materialize(blocks.groupBy(*keys).agg(F.sum(F.size("x")).alias("_size")))
    few, many = (sizes.filter(c).select(*keys) for c in (F.col("_size") <= WHOLE_VALUES, F.col("_size") > WHOLE_VALUES))
    how = (n_ch, keys, variance, seed, max_iter, tol, method)
    models = _fit_whole(lookup_join(blocks, few, keys), *how)
    if many.limit(1).count():
        models = models.unionByName(_fit_by_steps(materialize(lookup_join(blocks, many, keys)), *how))
    models = materialize(models)
    open_ = models.filter(~F.col("converged")).count()
    if open_:
        warnings.warn(f"{open_} models still moved by more than {tol} after {max_iter} steps")
    return models


def _fit_whole(blocks: DataFrame, n_ch: int, keys: list[str], variance: float | None, seed: int, max_iter: int, tol: float, method: str) -> DataFrame:
    @F.pandas_udf("k int, mean array<double>, unmixing array<double>, mixing array<double>, iterations int, converged boolean")
    def fit(x: pd.Series) -> pd.DataFrame:
        done = fit_together([np.asarray(flat, float).reshape(-1, n_ch) for flat in x], variance, seed, method, max_iter, tol)
        return pd.DataFrame(done, columns=["k", "mean", "unmixing", "mixing", "iterations", "converged"])

    own = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", "x"))).alias("_b"))
    return own.select(*keys, fit(F.flatten(F.transform("_b", lambda b: b["x"]))).alias("_m")).select(*keys, "_m.*")


def _fit_by_steps(blocks: DataFrame, n_ch: int, keys: list[str], variance: float | None, seed: int, max_iter: int, tol: float, method: str) -> DataFrame:
    @F.pandas_udf("k int, n bigint, mean array<double>, white array<double>, w array<double>, last array<double>, rate double")
    def start(moments: pd.Series) -> pd.DataFrame:
        out = []
        for m in moments:
            mean, white, n = whitening(np.asarray(m, float).reshape(n_ch + 1, n_ch + 1), variance)
            w, last, rate, *_ = begin(len(white), seed)
            out.append((len(white), n, mean, white.ravel(), w.ravel(), last.ravel(), rate[0]))
        return pd.DataFrame(out, columns=["k", "n", "mean", "white", "w", "last", "rate"])

    @F.pandas_udf("array<double>")
    def partial(frame: pd.DataFrame) -> pd.Series:
        out = []
        for x, k, mean, white, w in zip(*(frame[c] for c in ("x", "k", "mean", "white", "w"))):
            z = (np.asarray(x, float).reshape(-1, n_ch) - np.asarray(mean)) @ np.asarray(white).reshape(k, n_ch).T
            out.append(np.concatenate([part.ravel() for part in contrast(z, np.asarray(w).reshape(k, k), method)]))
        return pd.Series(out, dtype=object)

    @F.pandas_udf("w array<double>, last array<double>, rate double, moved double")
    def update(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for sums, k, n, w, last, rate in zip(*(frame[c] for c in ("sums", "k", "n", "w", "last", "rate"))):
            sums, w, last = np.asarray(sums) / n, np.asarray(w).reshape(k, k), np.asarray(last).reshape(k, k)
            new, last, rate, moved = next_unmixing(w, sums[:k * k].reshape(k, k), sums[k * k:], last, np.asarray(rate), method)
            out.append((new.ravel(), last.ravel(), float(rate), float(moved)))
        return pd.DataFrame(out, columns=["w", "last", "rate", "moved"])

    begun = keyed_moments(blocks, n_ch, keys).select(*keys, start("moments").alias("_m")).select(*keys, "_m.*")
    models = materialize(begun.select("*", F.lit(0).alias("iterations"), (F.col("k") == 0).alias("converged")))
    small = memory_bytes(models) <= MAX_BROADCAST_BYTES  # a model keeps its size from step to step
    for step in range(1, max_iter + 1):
        moving = models.filter(~F.col("converged"))
        if moving.limit(1).count() == 0:
            break
        now = moving.select(*keys, "k", "mean", "white", "w")
        met = blocks.join(F.broadcast(now), keys) if small else spread_join(blocks, now, keys, "_block")
        sums = sum_vectors(met.select(*keys, partial(F.struct("x", "k", "mean", "white", "w")).alias("sums")), keys, "sums")
        new = moving.join(sums, keys).withColumn("_u", update(F.struct("sums", "k", "n", "w", "last", "rate")))
        new = new.select(*keys, "k", "n", "mean", "white", "_u.w", "_u.last", "_u.rate", F.lit(step).alias("iterations"),
                         (F.col("_u.moved") < tol).alias("converged"))
        then = materialize(new.unionByName(models.filter("converged")))
        drop_table(models)
        models = then

    @F.pandas_udf("unmixing array<double>, mixing array<double>")
    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k, white, w in zip(frame["k"], frame["white"], frame["w"]):
            un, mix = _components(np.asarray(w).reshape(k, k), np.asarray(white).reshape(k, n_ch))
            out.append((un.ravel(), mix.ravel()))
        return pd.DataFrame(out, columns=["unmixing", "mixing"])

    done = models.withColumn("_u", finish(F.struct("k", "white", "w")))
    return done.select(*keys, "k", "mean", "_u.*", "iterations", "converged")


def ica_apply_keyed(frames: DataFrame, models: DataFrame, keys: list[str], exclude: str = "exclude") -> DataFrame:
    """Subtract from every frame the components of its key's model that the array column ``exclude`` lists.

    Frames without a model or with an empty or null list stay as they are.
    """
    joined = spread_join(frames, models.select(*keys, "k", F.col("mean").alias("_mean"), "unmixing", "mixing"), keys, "sample_idx", "left")

    @F.pandas_udf("array<double>")
    def apply(frame: pd.DataFrame) -> pd.Series:
        out = list(frame["values"])
        groups: dict[tuple, list[int]] = {}
        for row, (drop, k, un) in enumerate(zip(frame["drop"], frame["k"], frame["unmixing"])):
            own = tuple(int(c) for c in drop if c < k) if drop is not None and un is not None else ()
            if own:
                groups.setdefault((own, np.asarray(un).tobytes()), []).append(row)
        for (own, _), rows in groups.items():
            at, first = list(own), rows[0]
            mean = np.asarray(frame["_mean"].iloc[first])
            un = np.asarray(frame["unmixing"].iloc[first]).reshape(-1, len(mean))
            mix = np.asarray(frame["mixing"].iloc[first]).reshape(len(mean), -1)
            x = np.stack([np.asarray(out[r], float) for r in rows])
            x = x - (x - mean) @ un[at].T @ mix[:, at].T
            for r, v in zip(rows, x):
                out[r] = v
        return pd.Series(out, dtype=object)

    parts = F.struct("values", F.col(exclude).alias("drop"), "k", "_mean", "unmixing", "mixing")
    return joined.withColumn("values", apply(parts)).select(*frames.columns)


def model_checks(frames: DataFrame, models: DataFrame, n_ch: int, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """``keys, k, white, fixed, inverse``: whether the components of each key have unit covariance, lie at a fixed point of
    the step, and whether mixing undoes unmixing on the kept space."""
    blocks = spread_join(pack_frames(frames, keys), models.select(*keys, "k", "mean", "unmixing"), keys, "_block")

    @F.pandas_udf("array<double>")
    def partial(frame: pd.DataFrame) -> pd.Series:
        out = []
        for x, k, mean, un in zip(*(frame[c] for c in ("x", "k", "mean", "unmixing"))):
            y = (np.asarray(x, float).reshape(-1, n_ch) - np.asarray(mean)) @ np.asarray(un).reshape(k, n_ch).T
            t = np.tanh(y)
            out.append(np.concatenate([[len(y)], (y.T @ y).ravel(), (t.T @ y).ravel(), (1 - t**2).sum(axis=0)]))
        return pd.Series(out, dtype=object)

    @F.pandas_udf("white boolean, fixed boolean, inverse boolean")
    def judge(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for sums, k, un, mix in zip(*(frame[c] for c in ("sums", "k", "unmixing", "mixing"))):
            sums = np.asarray(sums)
            n, cov, cross, slope = sums[0], sums[1:k * k + 1], sums[k * k + 1:2 * k * k + 1], sums[2 * k * k + 1:]
            step = decorrelate(cross.reshape(k, k) / n - np.diag(slope / n))
            un, mix = np.asarray(un).reshape(k, n_ch), np.asarray(mix).reshape(n_ch, k)
            out.append((
                bool(np.abs(cov.reshape(k, k) / n - np.eye(k)).max() < tolerance),
                bool(np.abs(np.abs(np.diag(step)) - 1).max() < tolerance), bool(np.abs(un @ mix - np.eye(k)).max() < tolerance),
            ))
        return pd.DataFrame(out, columns=["white", "fixed", "inverse"])

    sums = sum_vectors(blocks.select(*keys, partial(F.struct("x", "k", "mean", "unmixing")).alias("sums")), keys, "sums")
    met = models.join(sums, keys).withColumn("_c", judge(F.struct("sums", "k", "unmixing", "mixing")))
    return met.select(*keys, "k", "_c.*")


def select_by_key(labels: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """``keys, exclude``: the components to drop for each key of ``labels(keys, component, label, proba)``."""
    from .ica import select_components

    return select_components(labels, rule).groupBy(*keys).agg(F.array_sort(F.collect_set(F.col("component").cast("int"))).alias("exclude"))
