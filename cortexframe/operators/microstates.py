"""Scalp-map clustering and back-fitting on frames ``(recording_id, sample_idx, values)``.

A frame holds all channels of one sample, so map products are local to a row. Maps are a small NumPy matrix
``(k, channels)`` shipped with the task; sums over samples are added inside tasks first.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.chunks import neighbour, sequence_index, signal_chunks
from ..plans.joins import bounded_collect
from ..plans.materialize import materialize
from ..plans.vectors import sum_vectors
from .windows import local_maxima

MAX_MAPS = 4096


def average_reference(frames: DataFrame) -> DataFrame:
    """Subtract the channel mean of every sample."""
    mean = F.aggregate("values", F.lit(0.0), lambda a, x: a + x) / F.size("values")
    return frames.withColumn("_m", mean).withColumn(
        "values", F.transform("values", lambda x: x - F.col("_m"))
    ).drop("_m")


def gfp(signals: DataFrame) -> DataFrame:
    """Global field power of long samples: population std over the channels of a sample."""
    return signals.groupBy("recording_id", "sample_idx").agg(F.stddev_pop("value").alias("gfp"))


def with_gfp(frames: DataFrame) -> DataFrame:
    """Average-referenced frames with their global field power."""
    ref = average_reference(frames)
    power = F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x) / F.size("values")
    return ref.withColumn("gfp", F.sqrt(power))


def gfp_peaks(frames: DataFrame) -> DataFrame:
    """Referenced frames at the strict local maxima of the field power."""
    return local_maxima(with_gfp(frames), ["recording_id"], "gfp")


def maps_matrix(maps: DataFrame) -> np.ndarray:
    """Collect a bounded map table ``(map_id, values)`` in map order."""
    rows = sorted(bounded_collect(maps.select("map_id", "values"), MAX_MAPS, "map table"), key=lambda r: r["map_id"])
    return np.array([r["values"] for r in rows], dtype=float)


def unit_norm(maps: np.ndarray) -> np.ndarray:
    return maps / np.sqrt((maps**2).sum(axis=1, keepdims=True))


def _fit(x: np.ndarray, g: np.ndarray, maps: np.ndarray):
    """Label with the largest squared spatial correlation (first on ties) and that correlation."""
    with np.errstate(divide="ignore", invalid="ignore"):
        c = x @ maps.T / (x.shape[1] * np.outer(g, maps.std(axis=1)))
    label = np.argmax(c**2, axis=1)
    return label, c[np.arange(len(x)), label]


def assign_maps(referenced: DataFrame, maps: np.ndarray) -> DataFrame:
    """Add ``label`` and ``corr`` to referenced frames with ``gfp``."""
    maps = np.asarray(maps, dtype=float)

    @F.pandas_udf("label bigint, corr double")
    def fit(values: pd.Series, g: pd.Series) -> pd.DataFrame:
        if not len(values):
            return pd.DataFrame({"label": pd.Series(dtype="int64"), "corr": pd.Series(dtype="float64")})
        label, corr = _fit(np.stack(values.to_numpy()), g.to_numpy(), maps)
        return pd.DataFrame({"label": label.astype("int64"), "corr": corr})

    return referenced.withColumn("_f", fit("values", "gfp")).select("*", "_f.label", "_f.corr").drop("_f")


def fit_back(frames: DataFrame, maps: np.ndarray, threshold: float | None = None) -> DataFrame:
    """Label of every sample; samples at or below the threshold are dropped."""
    out = assign_maps(with_gfp(frames), maps).select("recording_id", "sample_idx", "label", F.abs("corr").alias("corr"))
    return out if threshold is None else out.filter(F.col("corr") > threshold)


def fit_back_peaks(frames: DataFrame, maps: np.ndarray, threshold: float | None = None) -> DataFrame:
    """Labels from the nearest field-power peak, from the first peak up to before the last one."""
    peaks = assign_maps(gfp_peaks(frames), maps).select("recording_id", "sample_idx", "label", "corr")
    if threshold is not None:
        peaks = peaks.filter(F.abs("corr") > threshold)
    pairs = neighbour(signal_chunks(peaks), ["recording_id"], ["sample_idx"], ["sample_idx", "label"], 1, "_next")
    pairs = pairs.filter(F.col("_next").isNotNull())
    mid = F.floor((F.col("sample_idx") + F.col("_next.sample_idx")) / 2)
    spread = pairs.select(
        "recording_id", "label", F.col("_next.label").alias("_nl"), mid.alias("_mid"),
        F.explode(F.sequence(F.col("sample_idx"), F.col("_next.sample_idx") - 1)).alias("sample_idx"),
    )
    return spread.select(
        "recording_id", "sample_idx", F.when(F.col("sample_idx") < F.col("_mid"), F.col("label")).otherwise(F.col("_nl")).alias("label")
    )


def gev(frames: DataFrame, maps: np.ndarray) -> DataFrame:
    """Explained variance share per map at the field-power peaks, and the total in every row."""
    fitted = assign_maps(gfp_peaks(frames), maps)
    part = fitted.groupBy("recording_id", "label").agg(
        F.sum(F.col("gfp") ** 2 * F.col("corr") ** 2).alias("_e"), F.sum(F.col("gfp") ** 2).alias("_p")
    )
    recs = part.groupBy("recording_id").agg(F.sum("_p").alias("_all"), F.sum("_e").alias("_te"))
    grid = recs.withColumn("label", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(len(maps) - 1).cast("bigint"))))
    out = grid.join(part.drop("_p"), ["recording_id", "label"], "left")
    return out.select(
        "recording_id", "label", (F.coalesce("_e", F.lit(0.0)) / F.col("_all")).alias("gev"),
        (F.col("_te") / F.col("_all")).alias("gev_total"),
    )


def cv_criterion(frames: DataFrame, maps: np.ndarray) -> DataFrame:
    """Residual variance of all samples against their unit-norm map, penalised by the number of maps."""
    maps = np.asarray(maps, dtype=float)
    k, n_ch = maps.shape

    @F.pandas_udf("p double, e double")
    def energy(values: pd.Series, label: pd.Series) -> pd.DataFrame:
        if not len(values):
            return pd.DataFrame({"p": [], "e": []}, dtype="float64")
        x = np.stack(values.to_numpy())
        return pd.DataFrame({"p": (x**2).sum(axis=1), "e": (maps[label.to_numpy()] * x).sum(axis=1) ** 2})

    fitted = assign_maps(with_gfp(frames), maps).select("recording_id", energy("values", "label").alias("s"))
    var = (F.sum("s.p") - F.sum("s.e")) / (F.count(F.lit(1)) * (n_ch - 1))
    return fitted.groupBy("recording_id").agg(var.alias("var")).withColumn(
        "cv", F.col("var") * (n_ch - 1) ** 2 / float(n_ch - k - 1) ** 2
    )


def wcss(frames: DataFrame, solutions: dict[int, np.ndarray]) -> DataFrame:
    """Sum of ``1 - c**2`` at the peaks for every solution ``k -> maps``."""
    peaks = gfp_peaks(frames).select("recording_id", "values", "gfp")
    mats = {int(k): np.asarray(m, dtype=float) for k, m in solutions.items()}
    ks = sorted(mats)

    @F.pandas_udf("array<double>")
    def loss(values: pd.Series, g: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype=object)
        x, gg = np.stack(values.to_numpy()), g.to_numpy()
        return pd.Series(list(np.column_stack([1 - _fit(x, gg, mats[k])[1] ** 2 for k in ks])))

    out = peaks.select("recording_id", F.posexplode(loss("values", "gfp")).alias("_i", "_v"))
    label = F.create_map(*[x for i, k in enumerate(ks) for x in (F.lit(i), F.lit(k))])
    return out.groupBy("recording_id", label[F.col("_i")].cast("bigint").alias("k")).agg(F.sum("_v").alias("wcss"))


def kl_criterion(curve: DataFrame, keys: list[str] = ["recording_id"]) -> DataFrame:
    """``|w[k+1] - 2 w[k] + w[k-1]| / w[k]`` for the inner points of a short curve over ``k``."""
    w = Window.partitionBy(*keys).orderBy("k")  # one row per tried k
    out = curve.withColumn("_a", F.lag("wcss").over(w)).withColumn("_b", F.lead("wcss").over(w))
    return out.filter(F.col("_a").isNotNull() & F.col("_b").isNotNull()).select(
        *keys, "k", (F.abs(F.col("_b") - 2 * F.col("wcss") + F.col("_a")) / F.col("wcss")).alias("kl")
    )


def _label_maps(peaks: DataFrame, runs: list[np.ndarray]) -> list[tuple[np.ndarray, float]]:
    """One pass over the peaks for all runs: per run its next maps and the power along them.

    Each task adds up the Gram matrices of its rows, one row per (run, label). Only these are shuffled; their sums become
    maps on the executors, and the driver gets one map per run and label.
    """
    n_ch = runs[0].shape[1]

    def add(batches):
        sums = [np.zeros((len(m), n_ch, n_ch)) for m in runs]
        for b in batches:
            x = np.stack(b["values"].to_numpy()) if len(b) else np.zeros((0, n_ch))
            if not len(x):
                continue
            g = x.std(axis=1)
            for r, m in enumerate(runs):
                label, _ = _fit(x, g, m)
                for k in range(len(m)):
                    xk = x[label == k]
                    sums[r][k] += xk.T @ xk
        rows = [(r, k, s.ravel()) for r, ss in enumerate(sums) for k, s in enumerate(ss)]
        yield pd.DataFrame(rows, columns=["run", "k", "s"])

    @F.pandas_udf("map array<double>, power double")
    def leading(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_leading_map(np.reshape(m, (n_ch, n_ch))) for m in s], columns=["map", "power"])

    parts = peaks.select("values").mapInPandas(add, "run int, k int, s array<double>")
    total = sum_vectors(parts, ["run", "k"], "s").select("run", "k", leading("s").alias("_l")).select("run", "k", "_l.*")
    got = {(r["run"], r["k"]): r for r in total.collect()}  # runs * k maps
    return [
        (np.array([got[r, k]["map"] for k in range(len(m))]), sum((got[r, k]["power"] for k in range(len(m))), 0.0))
        for r, m in enumerate(runs)
    ]


def _seed_maps(peaks: DataFrame, n: int, seed: int) -> np.ndarray:
    """``n`` distinct peak frames in seeded hash order, unit norm."""
    rows = peaks.select("values", F.xxhash64("recording_id", "sample_idx", F.lit(seed)).alias("_h")).orderBy("_h").limit(n).collect()
    return unit_norm(np.array([r["values"] for r in rows], dtype=float))


def kmeans_restarts(
    frames: DataFrame, k: int, restarts: int = 8, seed: int = 42, max_err: float = 1e-6, max_iter: int = 1000
) -> tuple[np.ndarray, float]:
    """Polarity-free k-means of the field-power peaks; the restart with the smallest cross-validation value wins."""
    return kmeans_by_k(frames, [k], restarts, seed, max_err, max_iter)[k]


def kmeans_by_k(
    frames: DataFrame, ks: list[int], restarts: int = 8, seed: int = 42, max_err: float = 1e-6, max_iter: int = 1000
) -> dict[int, tuple[np.ndarray, float]]:
    """Best maps and cross-validation value for every number of maps in ``ks``.

    All restarts of all ``ks`` advance together: an iteration is one job over the stored peaks, whatever their number, and
    one more job gives all cross-validation values. New maps are the leading eigenvectors of the per-label Gram matrices.
    Restarts that end at ``max_iter`` are warned of.
    """
    stored = materialize(gfp_peaks(frames).select("recording_id", "sample_idx", "values"))
    names = [(k, r) for k in ks for r in range(restarts)]
    drawn = [_seed_maps(stored, max(ks), seed + r) for r in range(restarts)]
    runs = {(k, r): drawn[r][:k] for k, r in names}
    n_ch = drawn[0].shape[1]
    energy = F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x)
    power, n = stored.agg(F.sum(energy), F.count(F.lit(1))).first()
    var, prev = dict.fromkeys(names, 1.0), dict.fromkeys(names, 0.0)
    moving = lambda name: abs((var[name] - prev[name]) / var[name]) > max_err
    for _ in range(max_iter):
        active = [name for name in names if moving(name)]
        if not active:
            break
        for name, (maps, explained) in zip(active, _label_maps(stored, [runs[name] for name in active])):
            runs[name] = maps
            prev[name], var[name] = var[name], (power - explained) / (n * (n_ch - 1))
    late = sum(map(moving, names))
    if late:
        warnings.warn(f"{late} of {len(names)} restarts did not settle in {max_iter} steps")
    scored = dict(zip(names, cv_totals(frames, [runs[name] for name in names])))
    out = {}
    for k in ks:
        best = min(range(restarts), key=lambda r: scored[k, r])
        out[k] = (runs[k, best], scored[k, best])
    return out


def _leading_map(gram: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit eigenvector of the largest eigenvalue of a Gram matrix, and the power along it."""
    vals, vecs = np.linalg.eigh(gram)
    top = int(np.argmax(np.abs(vals)))
    own = vecs[:, top] / np.sqrt((vecs[:, top] ** 2).sum())
    return own, float(own @ gram @ own)


def cv_totals(frames: DataFrame, solutions: list[np.ndarray]) -> list[float]:
    """Cross-validation values of several solutions over all samples of all recordings, in one pass."""
    def add(batches):
        left, n = np.zeros(len(solutions)), 0
        for b in batches:
            x = np.stack(b["values"].to_numpy()) if len(b) else np.zeros((0, solutions[0].shape[1]))
            if not len(x):
                continue
            n += len(x)
            total, g = (x**2).sum(), x.std(axis=1)
            for i, maps in enumerate(solutions):
                label, _ = _fit(x, g, maps)
                left[i] += total - ((x * maps[label]).sum(axis=1) ** 2).sum()
        yield pd.DataFrame({"s": [np.append(left, float(n))]})

    sums = np.asarray(sum_vectors(average_reference(frames).select("values").mapInPandas(add, "s array<double>"), [], "s").first()["s"])
    out = []
    for left, maps in zip(sums[:-1], solutions):
        k, n_ch = maps.shape
        out.append(float(left / (sums[-1] * (n_ch - 1)) * (n_ch - 1) ** 2 / (n_ch - k - 1) ** 2))
    return out


def cv_total(frames: DataFrame, maps: np.ndarray) -> float:
    """Cross-validation value over all samples of all recordings."""
    return cv_totals(frames, [np.asarray(maps, dtype=float)])[0]


def select_k(frames: DataFrame, k_max: int, restarts: int = 8, seed: int = 42, k_min: int = 4) -> dict[int, tuple[np.ndarray, float]]:
    """Best maps and cross-validation value for every ``k`` from ``k_min`` to ``k_max``, fitted in common passes."""
    return kmeans_by_k(frames, list(range(k_min, k_max + 1)), restarts, seed)


def analyze(frames: DataFrame, k_max: int = 8, restarts: int = 8, seed: int = 42, k_min: int = 4) -> tuple[DataFrame, np.ndarray, float]:
    """The whole flow up to the label sequence: maps for every ``k``, the ``k`` with the least cross-validation value, and
    the labels of all samples from their nearest field-power peak. Returns labels, maps and the value."""
    found = select_k(frames, k_max, restarts, seed, k_min)
    k = min(found, key=lambda n: found[n][1])
    return fit_back_peaks(frames, found[k][0]), *found[k]


def _pearson(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a = a - a.mean(axis=1, keepdims=True)
    b = b - b.mean(axis=1, keepdims=True)
    return (a @ b.T) / np.outer(np.sqrt((a**2).sum(axis=1)), np.sqrt((b**2).sum(axis=1)))


def best_permutation(a: np.ndarray, b: np.ndarray, polarity: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Assignment ``p`` maximising the mean correlation of ``a[p[j]]`` with ``b[j]``; sign per pair."""
    k = len(b)
    r = _pearson(a, b)
    best = assign((r if polarity else np.abs(r))[None])[0]
    picked = r[best, np.arange(k)]
    return best, np.where(picked < 0, -1, 1), float((picked if polarity else np.abs(picked)).sum() / k)


def assign(gains: np.ndarray) -> np.ndarray:
    """For each ``k x k`` matrix the rows ``p`` with the largest sum of ``gains[p[j], j]``; the first in order of equals.

    Dynamic programming over the sets of rows that are left for the last columns: ``k 2**k`` steps that serve all matrices
    at once, instead of ``k!`` permutations.
    """
    n, k, _ = gains.shape
    sets = np.arange(1 << k)
    size = np.array([int(s).bit_count() for s in sets])
    best = np.full((n, 1 << k), -np.inf)  # of the rows in a set on the last columns
    best[:, 0] = 0.0
    for j in range(k - 1, -1, -1):
        own = sets[size == k - j]
        for row in range(k):
            has = own[(own >> row) & 1 == 1]
            best[:, has] = np.maximum(best[:, has], gains[:, row, j, None] + best[:, has ^ (1 << row)])
    out, left = np.zeros((n, k), np.int64), np.full(n, (1 << k) - 1)
    for j in range(k):
        found = np.zeros(n, bool)
        rest = left.copy()
        for row in range(k):
            able = ~found & ((left >> row) & 1 == 1)
            then = left ^ (1 << row)
            hit = able & (gains[:, row, j] + best[np.arange(n), np.where(able, then, 0)] >= best[np.arange(n), left])
            out[hit, j], rest[hit] = row, then[hit]
            found |= hit
        left = rest
    return out


def _stacked(maps: DataFrame) -> DataFrame:
    """One row per run with its few maps in map order."""
    return maps.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("map_id", "values")))["values"].alias("maps"))


def match_maps(runs: DataFrame, template: np.ndarray, polarity: bool = False) -> DataFrame:
    """Match the maps of every run to a template: ``run_id, target, map_id, sign, similarity``."""
    template = np.asarray(template, dtype=float)

    @F.pandas_udf("perm array<bigint>, sign array<bigint>, similarity double")
    def match(maps: pd.Series) -> pd.DataFrame:
        rows = [best_permutation(np.stack([np.asarray(m, dtype=float) for m in x]), template, polarity) for x in maps]
        return pd.DataFrame({"perm": [r[0].astype("int64") for r in rows], "sign": [r[1].astype("int64") for r in rows],
                             "similarity": [r[2] for r in rows]})

    out = _stacked(runs).select("run_id", match("maps").alias("m"))
    flat = out.select("run_id", "m.similarity", F.posexplode(F.arrays_zip("m.perm", "m.sign")).alias("target", "z"))
    return flat.select("run_id", F.col("target").cast("bigint").alias("target"), F.col("z.perm").alias("map_id"),
                       F.col("z.sign").alias("sign"), "similarity")


def reorder_maps(runs: DataFrame, template: np.ndarray | None = None, order: list[int] | None = None,
                 sign: list[int] | None = None) -> DataFrame:
    """Maps in template order with matched signs, or in an explicit order with explicit signs."""
    if template is not None:
        plan = match_maps(runs, template).select("run_id", "target", "map_id", "sign")
        joined = runs.join(plan, ["run_id", "map_id"])
    else:
        spark = runs.sparkSession
        plan = spark.createDataFrame(
            [(i, int(j), int(s)) for i, (j, s) in enumerate(zip(order, sign))], "target bigint, map_id bigint, sign bigint")
        joined = runs.join(F.broadcast(plan), "map_id")  # k rows
    return joined.select("run_id", F.col("target").alias("map_id"), F.transform("values", lambda x: x * F.col("sign")).alias("values"))


def _drawn_maps(runs: DataFrame, k: int, n_runs: int, seed: int) -> list[np.ndarray]:
    """``k`` maps for each of ``n_runs`` starts, drawn by position from the maps of all runs."""
    placed = materialize(sequence_index(runs.select("run_id", "map_id", "values"), [], ["run_id", "map_id"], "_pos"))
    total, rng = placed.count(), np.random.default_rng(seed)
    if total < k:
        raise ValueError(f"{total} maps are too few for {k} means")
    picks = [rng.choice(total, k, replace=False) for _ in range(n_runs)]
    wanted = sorted({int(p) for own in picks for p in own})
    positions = runs.sparkSession.createDataFrame([(p,) for p in wanted], "_pos bigint")
    rows = placed.join(F.broadcast(positions), "_pos").select("_pos", "values").collect()  # at most n_runs * k
    found = {r["_pos"]: np.asarray(r["values"], dtype=float) for r in rows}
    return [np.stack([found[int(p)] for p in own]) for own in picks]


def mean_maps(
    runs: DataFrame, k: int, n_runs: int = 200, seed: int = 42, max_iter: int = 1000, compat: bool = False
) -> tuple[np.ndarray, float, float]:
    """Mean maps over all runs: match to the current mean, average the signed matches, until labels repeat.

    All ``n_runs`` random starts advance in one job per iteration; the state on the driver is their mean maps.
    ``compat=True`` averages map ``j`` into class ``p[j]`` instead of map ``p[j]`` into class ``j``.
    Returns the maps of the best start and the mean and standard deviation of its similarity.
    """
    stored = materialize(_stacked(runs))
    drawn = _drawn_maps(runs, k, n_runs, seed)
    current = dict(enumerate(drawn))
    previous: dict[int, np.ndarray] = {}
    done: dict[int, tuple[np.ndarray, float, float]] = {}
    best_seen: dict[int, tuple[np.ndarray, float, float]] = {}
    n_ch = drawn[0].shape[1]
    for _ in range(max_iter + 1):
        now, before = dict(current), dict(previous)

        def step(batches):
            acc = {i: [np.zeros((k, n_ch)), 0.0, 0.0, 0, 0] for i in now}
            for b in batches:
                for maps in b["maps"]:
                    a = np.stack([np.asarray(m, dtype=float) for m in maps])
                    for i, mean in now.items():
                        p, s, sim = best_permutation(a, mean)
                        t = acc[i]
                        if compat:
                            t[0][p] += a * s[:, None]
                        else:
                            t[0] += a[p] * s[:, None]
                        t[1] += sim
                        t[2] += sim * sim
                        t[3] += 1
                        t[4] += 0 if i in before and (best_permutation(a, before[i])[0] == p).all() else 1
            yield pd.DataFrame([(i, t[0].ravel(), t[1], t[2], t[3], t[4]) for i, t in acc.items()],
                               columns=["start", "s", "sim", "sim2", "n", "changed"])

        part = stored.mapInPandas(step, "start int, s array<double>, sim double, sim2 double, n bigint, changed bigint")
        vec = sum_vectors(part, ["start"], "s")
        tot = part.groupBy("start").agg(*[F.sum(c).alias(c) for c in ("sim", "sim2", "n", "changed")])
        for row in vec.join(tot, "start").collect():  # one row per random start
            i, n = row["start"], row["n"]
            mean_sim = row["sim"] / n
            std_sim = float(np.sqrt(max(row["sim2"] / n - mean_sim**2, 0.0)))
            state = (now[i], mean_sim, std_sim)
            if i not in best_seen or mean_sim > best_seen[i][1]:
                best_seen[i] = state
            if row["changed"] == 0:
                done[i] = state
                current.pop(i)
                previous.pop(i, None)
            else:
                previous[i] = now[i]
                current[i] = np.array(row["s"]).reshape(k, n_ch) / n
        if not current:
            break
    if current:
        warnings.warn(f"{len(current)} of {n_runs} starts did not settle in {max_iter} steps")
    for i in current:
        done[i] = best_seen[i]
    return max(done.values(), key=lambda t: t[1])
