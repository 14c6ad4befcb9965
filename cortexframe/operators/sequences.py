"""Statistics and complexity of label sequences ``(recording_id, sample_idx, label)``."""

from __future__ import annotations

import lzma
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.chunks import CHUNK, CHUNK_SAMPLES, runs, sample_halo, signal_chunks
from ..plans.materialize import materialize
from .windows import sliding_windows

REC = ["recording_id"]


def _states(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Every key with all ``k`` states."""
    return df.select(*keys).distinct().withColumn("label", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))))


def _label_runs(labels: DataFrame, window: int | None, step: int | None, chunk: int) -> tuple[DataFrame, list[str]]:
    if window is None:
        return runs(signal_chunks(labels, chunk), REC, "sample_idx", "label"), REC
    win = sliding_windows(labels, window, step, REC).withColumn(CHUNK, F.lit(0).cast("bigint"))
    return runs(win, [*REC, "win"], "offset", "label"), [*REC, "win"]  # a window is the bounded chunk


def duration(labels: DataFrame, k: int, window: int | None = None, step: int | None = None, chunk: int = CHUNK_SAMPLES) -> DataFrame:
    """Mean run length per state; the last run is not counted and a state without runs gets 1."""
    r, keys = _label_runs(labels, window, step, chunk)
    mean = r.filter(~F.col("is_last")).groupBy(*keys, "label").agg(F.avg("run_len").alias("_d"))
    return _states(r, keys, k).join(mean, [*keys, "label"], "left").select(*keys, "label", F.coalesce("_d", F.lit(1.0)).alias("duration"))


def occurrence(labels: DataFrame, k: int, window: int, step: int | None = None, chunk: int = CHUNK_SAMPLES) -> DataFrame:
    """With ``step``: runs per state in every window, the last one included.

    Without: mean over the full blocks of ``window`` samples in which the state has a run other than the last.
    """
    if step is not None:
        r, keys = _label_runs(labels, window, step, chunk)
        n = r.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_n"))
        return _states(r, keys, k).join(n, [*keys, "label"], "left").select(
            *keys, "label", F.coalesce("_n", F.lit(0)).cast("double").alias("occurrence"))
    r, keys = _label_runs(labels, window, window, chunk)
    n = r.filter(~F.col("is_last")).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_n"))
    mean = n.groupBy(*REC, "label").agg(F.avg("_n").alias("occurrence"))
    return _states(r, REC, k).join(mean, [*REC, "label"], "left").select(*REC, "label", "occurrence")


def coverage(labels: DataFrame, k: int, window: int | None = None, step: int | None = None) -> DataFrame:
    """Share of samples per state."""
    df, keys = (labels, REC) if window is None else (sliding_windows(labels, window, step, REC), [*REC, "win"])
    shares = [F.avg(F.when(F.col("label") == s, 1.0).otherwise(0.0)).alias(f"_{s}") for s in range(k)]
    wide = df.groupBy(*keys).agg(*shares)
    rows = F.array(*[F.struct(F.lit(s).cast("bigint").alias("label"), F.col(f"_{s}").alias("coverage")) for s in range(k)])
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def state_subsets(n_states: int, k: int) -> list[tuple[int, ...]]:
    """All ``k``-subsets of the states; for even ``k`` only the first half (complements repeat)."""
    subsets = list(combinations(range(n_states), k))
    return subsets[: comb(n_states, k) // 2] if k % 2 == 0 else subsets


def random_walk(labels: DataFrame, n_states: int, k: int) -> DataFrame:
    """Steps +1 / -1 per subset of states: +1 where the label is in the subset."""
    steps = F.array(*[
        F.struct(F.lit("_".join(map(str, s))).alias("subset"), F.when(F.col("label").isin(list(s)), 1.0).otherwise(-1.0).alias("step"))
        for s in state_subsets(n_states, k)
    ])
    return labels.select("recording_id", "sample_idx", F.explode(steps).alias("w")).select("recording_id", "sample_idx", "w.*")


def dfa_scales(lo: float, hi: float, density: float = 0.25) -> list[int]:
    out, i = [], 0
    while lo + i * density < hi:
        out.append(int(2 ** (lo + i * density)))
        i += 1
    return out


def _window_moments(y: np.ndarray, at: np.ndarray, scale: int) -> tuple[np.ndarray, ...]:
    """Window number, size and central moments of ``y`` against the place in the window, for sorted positions ``at``."""
    w = at // scale
    first = np.flatnonzero(np.diff(w, prepend=w[0] - 1))
    n = np.diff(first, append=len(w))
    x = (at - w * scale).astype(float)
    mx, my = np.add.reduceat(x, first) / n, np.add.reduceat(y, first) / n
    dx, dy = x - np.repeat(mx, n), y - np.repeat(my, n)
    return w[first], n, mx, my, *(np.add.reduceat(v, first) for v in (dx * dx, dx * dy, dy * dy))


def _left_over(sxx: np.ndarray, sxy: np.ndarray, syy: np.ndarray) -> np.ndarray:
    slope = np.divide(sxy, sxx, out=np.zeros_like(sxy), where=sxx > 0)
    return np.maximum(syy - slope * sxy, 0.0)


def dfa_sketch(walk: DataFrame, scales: list[int], keys: list[str], chunk: int = CHUNK_SAMPLES) -> DataFrame:
    """Moments of all scales per chunk, from one pass that sums the steps from the chunk's first sample on.

    Per scale a chunk gives one row for the windows that it holds whole (``w`` is null, ``n`` windows, ``syy`` their summed
    squares around the fits) and one for each of the at most two windows that it shares. ``total`` is the sum of its steps.
    """
    parts = signal_chunks(walk.select(*keys, "sample_idx", "step"), chunk)
    names = ["total", "scale_idx", "w", "n", "mx", "my", "sxx", "sxy", "syy"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample_idx")
        at, y = pdf["sample_idx"].to_numpy(np.int64), np.cumsum(pdf["step"].to_numpy(float))
        rows = []
        for i, scale in enumerate(scales):
            w, n, mx, my, sxx, sxy, syy = _window_moments(y, at, scale)
            whole = n == scale
            if whole.any():
                sse = float(_left_over(sxx[whole], sxy[whole], syy[whole]).sum())
                rows.append((i, None, int(whole.sum()), None, None, None, None, sse))
            rows += [(i, *v) for v in zip(*(c[~whole].tolist() for c in (w, n, mx, my, sxx, sxy, syy)))]
        out = pd.DataFrame(rows, columns=names[1:]).astype({"w": "Int64"})
        out.insert(0, "total", float(y[-1]))
        for c in reversed([*keys, CHUNK]):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    kinds = {f.name: f.dataType.simpleString() for f in parts.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, CHUNK])
    schema += ", total double, scale_idx bigint, w bigint, n bigint, mx double, my double, sxx double, sxy double, syy double"
    return parts.groupBy(*keys, CHUNK).applyInPandas(run, schema)


def dfa(walk: DataFrame, scales: list[int], keys: list[str] = ["recording_id", "subset"], chunk: int = CHUNK_SAMPLES) -> DataFrame:
    """Detrended fluctuation of the walk per scale: ``keys, scale_idx, scale, fluctuation``.

    The samples of a key are dense and start at 0; the last, shorter window of a scale is left out, and a scale longer than
    the walk gives no row. Centring the steps adds a line to the profile, which every fit takes out again, so the mean is not
    needed. The rows are read and moved once for all scales: each chunk leaves a few rows per scale, and only windows across
    chunk borders are put together afterwards.
    """
    sketch = materialize(dfa_sketch(walk, scales, keys, chunk))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    start = sketch.groupBy(*keys, CHUNK).agg(F.first("total").alias("total")).select(
        *keys, CHUNK, F.coalesce(F.sum("total").over(before), F.lit(0.0)).alias("_y0"))
    cut = sketch.filter("w is not null").join(start, [*keys, CHUNK]).withColumn("my", F.col("my") + F.col("_y0"))
    own = [*keys, "scale_idx", "w"]
    level = cut.groupBy(*own).agg(F.min_by("my", CHUNK).alias("_b"))
    cut = cut.join(level, own).withColumn("my", F.col("my") - F.col("_b"))
    n, mx, my = F.col("n"), F.col("mx"), F.col("my")
    between = lambda a, b: F.sum(n * a * b) - F.sum(n * a) * F.sum(n * b) / F.sum(n)
    joined = cut.groupBy(*own).agg(
        F.sum("n").alias("n"), (F.sum("sxx") + between(mx, mx)).alias("sxx"),
        (F.sum("sxy") + between(mx, my)).alias("sxy"), (F.sum("syy") + between(my, my)).alias("syy"))
    sizes = F.array(*[F.lit(v).cast("bigint") for v in scales])
    scale = F.get(sizes, F.col("scale_idx").cast("int"))
    fit = F.coalesce(F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0))
    across = joined.filter(n == scale).select(
        *keys, "scale_idx", F.lit(1).cast("bigint").alias("n"), F.greatest(F.col("syy") - fit, F.lit(0.0)).alias("syy"))
    every = across.unionByName(sketch.filter("w is null").select(*keys, "scale_idx", "n", "syy"))
    return every.groupBy(*keys, "scale_idx").agg((F.sum("syy") / F.sum("n")).alias("_s")).select(
        *keys, "scale_idx", scale.alias("scale"), F.sqrt(F.col("_s") / scale).alias("fluctuation"))


def dfa_slope(fluctuations: DataFrame, keys: list[str] = ["recording_id", "subset"]) -> DataFrame:
    pos = fluctuations.filter("fluctuation > 0")
    return pos.groupBy(*keys).agg(
        F.regr_slope(F.log2("fluctuation"), F.log2(F.col("scale").cast("double"))).alias("slope"))


def _entropy(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Shannon entropy in bits from counts: ``log2 N - sum(n log2 n) / N``."""
    total = F.sum(n)
    return counts.groupBy(*keys).agg(
        (F.log2(total.cast("double")) - F.sum(F.col(n) * F.log2(F.col(n).cast("double"))) / total).alias("entropy"))


def entropy(labels: DataFrame) -> DataFrame:
    return _entropy(labels.groupBy(*REC, "label").agg(F.count(F.lit(1)).alias("n")), REC)


def joint_entropy(pairs: DataFrame, keys: list[str] = REC, x: str = "x", y: str = "y") -> DataFrame:
    return _entropy(pairs.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("n")), keys)


def _ahead(labels: DataFrame, n: int, chunk: int) -> DataFrame:
    """``_ahead``: the label and its ``n - 1`` successors (shorter at the end of the sequence)."""
    halo = sample_halo(labels, 0, n - 1, chunk)
    w = Window.partitionBy(*REC, CHUNK).orderBy("sample_idx").rowsBetween(0, n - 1)
    return halo.withColumn("_ahead", F.collect_list("label").over(w)).filter("_own").drop("_own", CHUNK)


def word_counts(labels: DataFrame, ks: list[int], include_last: bool = False, chunk: int = CHUNK_SAMPLES) -> DataFrame:
    """Counts of words of every length in ``ks``: ``recording_id, k, word, n``.

    The last word of a sequence is left out unless ``include_last``; one pass serves all lengths.
    """
    need = 0 if include_last else 1
    ahead = _ahead(labels, max(ks) + need, chunk)
    rows = F.array(*[
        F.when(F.size("_ahead") >= k + need, F.struct(F.lit(k).cast("bigint").alias("k"), F.concat_ws("_", F.slice("_ahead", 1, k).cast("array<string>")).alias("word")))
        for k in ks
    ])
    words = ahead.select("recording_id", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("w")).select("recording_id", "w.*")
    return words.groupBy(*REC, "k", "word").agg(F.count(F.lit(1)).alias("n"))


def word_entropy(labels: DataFrame, ks: list[int], include_last: bool = False, chunk: int = CHUNK_SAMPLES) -> DataFrame:
    return _entropy(word_counts(labels, ks, include_last, chunk), [*REC, "k"])


def mutual_information(labels: DataFrame, lags: int, chunk: int = CHUNK_SAMPLES) -> DataFrame:
    """``H(x) + H(x shifted) - H(joint)`` for lags ``0 .. lags - 1``; one pass counts all label pairs."""
    ahead = _ahead(labels, lags, chunk)
    flat = ahead.select("recording_id", F.col("label").alias("x"), F.posexplode("_ahead").alias("lag", "y"))
    counts = flat.groupBy(*REC, F.col("lag").cast("bigint").alias("lag"), "x", "y").agg(F.count(F.lit(1)).alias("n"))
    keys = [*REC, "lag"]
    hxy = _entropy(counts, keys).withColumnRenamed("entropy", "hxy")
    hx = _entropy(counts.groupBy(*keys, "x").agg(F.sum("n").alias("n")), keys).withColumnRenamed("entropy", "hx")
    hy = _entropy(counts.groupBy(*keys, "y").agg(F.sum("n").alias("n")), keys).withColumnRenamed("entropy", "hy")
    return hx.join(hy, keys).join(hxy, keys).select(*keys, (F.col("hx") + F.col("hy") - F.col("hxy")).alias("mi"))


def partial_mutual_information(labels: DataFrame, lags: int, compat: bool = False, chunk: int = CHUNK_SAMPLES) -> DataFrame:
    """Mutual information at lags 0 and 1, then ``2 H_k - H_(k-1) - H_(k+1)`` of word entropies.

    ``compat=True`` uses the number of lags as the word length for every ``k >= 2``.
    """
    first = mutual_information(labels, 2, chunk).filter(F.col("lag") < lags).select(*REC, "lag", F.col("mi").alias("pmi"))
    if lags <= 2:
        return first
    lengths = [lags - 1, lags, lags + 1] if compat else list(range(1, lags + 1))
    h = word_entropy(labels, lengths, chunk=chunk)
    wide = h.groupBy(*REC).agg(F.map_from_entries(F.collect_list(F.struct("k", "entropy"))).alias("_h"))
    get = lambda k: F.try_element_at("_h", F.lit(k).cast("bigint"))
    rows = F.array(*[
        F.struct(F.lit(lag).cast("bigint").alias("lag"), (2 * get(k) - get(k - 1) - get(k + 1)).alias("pmi"))
        for lag in range(2, lags) for k in [lags if compat else lag]
    ])
    rest = wide.select("recording_id", F.explode(rows).alias("r")).select("recording_id", "r.*")
    return first.unionByName(rest)


def entropy_rate_excess(labels: DataFrame, k_max: int, chunk: int = CHUNK_SAMPLES) -> DataFrame:
    """Line through the word entropies over their length: slope = entropy rate, intercept = excess entropy."""
    h = word_entropy(labels, list(range(1, k_max + 1)), chunk=chunk)
    x = F.col("k").cast("double")
    return h.groupBy(*REC).agg(
        F.regr_slope("entropy", x).alias("entropy_rate"), F.regr_intercept("entropy", x).alias("excess_entropy"))


MAX_WHOLE = 50_000_000


@F.pandas_udf(T.LongType())
def _compressed_size(sequence: pd.Series) -> pd.Series:
    return sequence.map(lambda s: len(lzma.compress(bytes(int(x) for x in s)))).astype("int64")


def lz_complexity(labels: DataFrame, window: int | None = None, step: int | None = None) -> DataFrame:
    """Length of the LZMA stream of the label bytes, per sliding window.

    A compressed length is defined on one contiguous string, so the whole-sequence form is limited to
    recordings of ``MAX_WHOLE`` labels and refuses longer ones; use windows there.
    """
    if window is None:
        n = labels.groupBy(*REC).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if n and n > MAX_WHOLE:
            raise ValueError("sequence too long for one compressed string; give window and step")
        df, keys, at = labels, REC, "sample_idx"
    else:
        df, keys, at = sliding_windows(labels, window, step, REC), [*REC, "win"], "offset"
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(at, "label")))["label"].alias("_s"))
    return packed.select(*keys, _compressed_size("_s").alias("lz"))


