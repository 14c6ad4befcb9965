import lzma

import numpy as np
import pytest
from pyspark.sql import functions as F

from series_helpers import collect_labels
from cortexframe.operators import microstates as ms
from cortexframe.operators import sequences as sq


def table(df, *keys, value):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


SEQS = {"a": [0, 0, 1, 1, 1, 0, 2, 2], "b": [2] * 9, "c": [0, 1, 2, 0, 1, 2, 2]}


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_duration_and_occurrence(spark, chunk):
    df = collect_labels(spark, SEQS)
    d = table(sq.duration(df, 4, chunk=chunk), "recording_id", "label", value="duration")
    assert [d["a", k] for k in range(4)] == [1.5, 3.0, 1.0, 1.0]  # the last run of 2 is not counted
    assert [d["b", k] for k in range(4)] == [1.0] * 4
    assert d["c", 2] == 1.0
    o = table(sq.occurrence(df, 3, 4, 2), "recording_id", "win", "label", value="occurrence")
    assert [o["a", 0, k] for k in range(3)] == [1, 1, 0] and [o["a", 2, k] for k in range(3)] == [1, 1, 1 - 1 + 1 - 1 + 1]
    blocks = table(sq.occurrence(df, 3, 4), "recording_id", "label", value="occurrence")
    assert blocks["a", 0] == 1.0 and blocks["a", 1] == 1.0 and blocks["a", 2] is None


def test_coverage_sums_to_one(spark):
    c = sq.coverage(collect_labels(spark, SEQS), 3).groupBy("recording_id").sum("coverage").collect()
    assert all(abs(r[1] - 1) < 1e-12 for r in c)


@pytest.mark.parametrize("chunk", [2, 5, 1000])
def test_words_and_information(spark, chunk):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, 300)
    df = collect_labels(spark, {"a": x})

    def h(words):
        n = np.unique(words, return_counts=True, axis=0)[1]
        p = n / n.sum()
        return -(p * np.log2(p)).sum()

    got = table(sq.word_entropy(df, [1, 2, 4], chunk=chunk), "k", value="entropy")
    for k in (1, 2, 4):
        assert abs(got[k,] - h(np.array([x[t:t + k] for t in range(len(x) - k)]))) < 1e-10
    mi = table(sq.mutual_information(df, 4, chunk=chunk), "lag", value="mi")
    for lag in range(4):
        a, b = x[:len(x) - lag], x[lag:]
        assert abs(mi[lag,] - (h(a) + h(b) - h(np.stack([a, b], 1)))) < 1e-10
    pmi = table(sq.partial_mutual_information(df, 4, chunk=chunk), "lag", value="pmi")
    assert len(pmi) == 4


@pytest.mark.parametrize("chunk", [7, 5000])
def test_dfa_of_white_noise(spark, chunk):
    x = np.random.default_rng(2).integers(0, 2, 2000)
    walk = sq.random_walk(collect_labels(spark, {"a": x}), 2, 1)
    scales = sq.dfa_scales(2, 8)
    f = table(sq.dfa(walk, scales, chunk=chunk).filter("subset = '0'"), "scale_idx", value="fluctuation")
    step = np.where(x == 0, 1.0, -1.0)
    y = np.cumsum(step - step.mean())
    for i, s in enumerate(scales):
        seg = y[: len(y) // s * s].reshape(-1, s)
        res = [np.mean((v - np.polyval(np.polyfit(np.arange(s), v, 1), np.arange(s))) ** 2) for v in seg]
        assert abs(f[i,] - np.sqrt(np.mean(res))) < 1e-8
    slope = sq.dfa_slope(sq.dfa(walk, scales)).first()["slope"]
    assert 0.4 < slope < 0.65


def test_subsets():
    assert sq.state_subsets(4, 2) == [(0, 1), (0, 2), (0, 3)]
    assert len(sq.state_subsets(5, 1)) == 5


def test_lz(spark):
    x = np.random.default_rng(0).integers(0, 4, 500)
    df = collect_labels(spark, {"a": x}).repartition(5)
    got = table(sq.lz_complexity(df, 200, 150), "win", value="lz")
    assert got == {(k,): len(lzma.compress(bytes(int(v) for v in x[k * 150:k * 150 + 200]))) for k in range(3)}
    assert sq.lz_complexity(df).first()["lz"] == len(lzma.compress(bytes(int(v) for v in x)))


def planted(spark, n=1200, k=3, n_ch=8, seed=4):
    rng = np.random.default_rng(seed)
    maps = rng.standard_normal((k, n_ch))
    maps -= maps.mean(axis=1, keepdims=True)
    maps = ms.unit_norm(maps)
    label = np.repeat(rng.integers(0, k, n // 20), 20)
    amp = np.abs(np.sin(np.arange(n) * 0.35)) + 0.1
    x = maps[label] * (amp * rng.choice([-1, 1], n))[:, None] + 0.01 * rng.standard_normal((n, n_ch))
    rows = [("a", i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "recording_id string, sample_idx bigint, values array<double>").repartition(6), maps, label


def test_kmeans_finds_planted_maps(spark):
    df, maps, label = planted(spark)
    got, cv = ms.kmeans_restarts(df, 3, restarts=4, seed=1, max_iter=40)
    r = np.abs(got @ maps.T)
    assert (r.max(axis=1) > 0.99).all() and len(set(r.argmax(axis=1))) == 3
    assert abs(cv - ms.cv_total(df, got)) < 1e-12
    fit = ms.fit_back(df, maps).orderBy("sample_idx").collect()
    assert np.mean([a["label"] == b for a, b in zip(fit, label)]) > 0.97
    total = ms.gev(df, got).collect()
    assert abs(sum(t["gev"] for t in total) - total[0]["gev_total"]) < 1e-12 and total[0]["gev_total"] > 0.95


def test_fit_back_peaks_by_hand(spark):
    df, maps, _ = planted(spark, n=200)
    peaks = ms.assign_maps(ms.gfp_peaks(df), maps).orderBy("sample_idx").collect()
    want = []
    for a, b in zip(peaks, peaks[1:]):
        mid = (a["sample_idx"] + b["sample_idx"]) // 2
        want += [a["label"]] * (mid - a["sample_idx"]) + [b["label"]] * (b["sample_idx"] - mid)
    got = ms.fit_back_peaks(df, maps).orderBy("sample_idx").collect()
    assert [r["label"] for r in got] == want and got[0]["sample_idx"] == peaks[0]["sample_idx"]


def test_matching_and_mean_maps(spark):
    rng = np.random.default_rng(3)
    truth = rng.standard_normal((4, 16))
    rows = []
    for run in range(7):
        p = rng.permutation(4)
        for j in range(4):
            rows.append((run, j, [float(v) for v in rng.choice([-1, 1]) * truth[p[j]] + 0.05 * rng.standard_normal(16)]))
    df = spark.createDataFrame(rows, "run_id bigint, map_id bigint, values array<double>").repartition(3)
    ordered = ms.reorder_maps(df, truth)
    for r in ordered.collect():
        assert np.corrcoef(r["values"], truth[r["map_id"]])[0, 1] > 0.95
    maps, sim, std = ms.mean_maps(df, 4, n_runs=6, seed=1, max_iter=30)
    p, _, score = ms.best_permutation(maps, truth)
    assert sorted(p) == [0, 1, 2, 3] and score > 0.99 and sim > 0.95 and std < 0.05
    ms.mean_maps(df, 4, n_runs=2, seed=1, max_iter=5, compat=True)
    fixed = ms.reorder_maps(df.filter("run_id = 0"), order=[1, 0, 2, 3], sign=[-1, 1, 1, 1])
    src = {r["map_id"]: r["values"] for r in df.filter("run_id = 0").collect()}
    assert {r["map_id"]: r["values"] for r in fixed.collect()}[0] == [-v for v in src[1]]


def test_select_k_penalises_extra_maps(spark):
    df, _, _ = planted(spark, n=400, k=4, n_ch=10)
    found = ms.select_k(df, 5, restarts=3, seed=2)
    assert set(found) == {4, 5} and all(np.isfinite(v[1]) for v in found.values())


@pytest.mark.parametrize("name,module,operator,settings", [
    ("art16_ica_fit", "ica", "ica_fit", {"variance": 0.99, "max_iter": 200}),
    ("art18_ica_apply", "ica", "ica_fit", {"variance": 0.99, "max_iter": 200}),
    ("mst3_modified_kmeans", "microstates", "kmeans_restarts", {"restarts": 8, "max_iter": 1000}),
    ("mst5_select_k", "microstates", "select_k", {"restarts": 8}),
    ("mst16_analyze", "microstates", "select_k", {"restarts": 8}),
    ("mst11_mean_maps", "microstates", "mean_maps", {"n_runs": 200, "max_iter": 1000}),
    ("cls1_stage_classifier_cv", "classifier", "stage_classifier_cv", {"folds": 5, "max_iter": 50}),
])
def test_queries_fit_with_whole_settings(monkeypatch, name, module, operator, settings):
    import importlib
    import inspect

    from cortexframe.operators import classifier
    from cortexframe.queries import QUERIES, fixtures, microstates_q

    class Called(Exception):
        pass

    home = importlib.import_module(f"cortexframe.operators.{module}")
    of = inspect.signature(getattr(home, operator))

    def fake(*args, **kwargs):
        bound = of.bind(*args, **kwargs)
        bound.apply_defaults()
        raise Called(bound.arguments)

    monkeypatch.setattr(home, operator, fake)
    for where, source in ((fixtures, "frames"), (fixtures, "signals"), (fixtures, "stages"), (microstates_q, "run_maps"), (classifier, "band_features")):
        monkeypatch.setattr(where, source, lambda *a: None)
    with pytest.raises(Called) as got:
        QUERIES[name](None, "")
    assert {k: got.value.args[0][k] for k in settings} == settings


def test_fits_that_end_at_the_limit_are_told(spark):
    from cortexframe.operators import ica

    rnd = np.random.default_rng(4)
    df = spark.createDataFrame([("r", i, [float(x) for x in v]) for i, v in enumerate(rnd.laplace(size=(300, 4)))], "recording_id string, sample_idx bigint, values array<double>")
    with pytest.warns(UserWarning, match="last of 1 steps"):
        assert not ica.ica_fit(df, 4, max_iter=1).converged
    with pytest.warns(UserWarning, match="did not settle in 1 steps"):
        ms.kmeans_restarts(df, 2, restarts=2, max_iter=1)


def test_assignment_equals_all_permutations():
    from itertools import permutations

    rng = np.random.default_rng(12)
    for k in range(1, 8):
        gains = np.round(rng.standard_normal((20, k, k)), 1)  # with ties
        perms = np.array(list(permutations(range(k))))
        for g, found in zip(gains, ms.assign(gains)):
            totals = g[perms, np.arange(k)].sum(axis=1)
            assert sorted(found.tolist()) == list(range(k))
            assert abs(g[found, np.arange(k)].sum() - totals.max()) < 1e-9


def test_twelve_maps_are_matched(spark):
    rng = np.random.default_rng(13)
    maps = rng.standard_normal((12, 30))
    order, sign = rng.permutation(12), rng.choice([-1, 1], 12)
    rows = [(0, j, (maps[order[j]] * sign[j]).tolist()) for j in range(12)]
    got = ms.reorder_maps(spark.createDataFrame(rows, "run_id int, map_id bigint, values array<double>"), maps).collect()
    assert all(np.allclose(r["values"], maps[r["map_id"]]) for r in got) and len(got) == 12


def test_all_k_and_restarts_advance_in_common_passes(spark):
    rng = np.random.default_rng(14)
    rows = [("a", i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 8)))]
    df = spark.createDataFrame(rows, "recording_id string, sample_idx bigint, values array<double>")
    together = ms.kmeans_by_k(df, [2, 3], restarts=3, seed=4)
    for k in (2, 3):
        alone, cv = ms.kmeans_restarts(df, k, restarts=3, seed=4)
        assert together[k][1] == pytest.approx(ms.cv_total(df, together[k][0]), rel=1e-12)
        assert cv == pytest.approx(ms.cv_criterion(df.withColumn("recording_id", F.lit("a")), alone).first()["cv"], rel=1e-9)
    labels, maps, cv = ms.analyze(df, 4, restarts=2, seed=4, k_min=2)
    assert cv == min(v for _, v in ms.select_k(df, 4, 2, 4, 2).values())
    assert labels.select("label").distinct().count() <= len(maps)


def test_dfa_chunks_leave_few_rows(spark):
    """Rows that leave a chunk do not grow with its samples, and windows longer than several chunks stay exact."""
    x = np.random.default_rng(5).integers(0, 3, 3000)
    walk = sq.random_walk(collect_labels(spark, {"a": x, "b": x[:50]}), 3, 1)
    scales = [2, 5, 64, 700, 2999, 3001]
    keys = ["recording_id", "subset"]
    rows = sq.dfa_sketch(walk, scales, keys, chunk=500)
    assert rows.groupBy(*keys, "_chunk", "scale_idx").count().filter("count > 3").count() == 0
    one, many = (
        {(r["recording_id"], r["subset"], r["scale"]): r["fluctuation"] for r in sq.dfa(walk, scales, chunk=c).collect()} for c in (65536, 101))
    assert one.keys() == many.keys() and len(one) == 3 * (5 + 2)
    for k, v in one.items():
        assert abs(many[k] - v) < 1e-8 * max(1, v)
    step = np.where(x == 0, 1.0, -1.0)
    y = np.cumsum(step - step.mean())[:2999]
    line = np.polyval(np.polyfit(np.arange(2999), y, 1), np.arange(2999))
    assert abs(one["a", "0", 2999] - np.sqrt(np.mean((y - line) ** 2))) < 1e-6


def test_clustering_sends_maps_and_no_matrices_to_the_driver(spark, monkeypatch):
    df, _, _ = planted(spark, n=200, k=3, n_ch=12)
    kind, sizes = type(df), []
    collect = kind.collect

    def spied(self):
        rows = collect(self)
        sizes.extend(len(v) for row in rows for v in row if isinstance(v, list))
        return rows

    monkeypatch.setattr(kind, "collect", spied)
    maps, _ = ms.kmeans_restarts(df, 3, restarts=2, seed=1)
    assert maps.shape == (3, 12) and np.allclose((maps**2).sum(axis=1), 1)
    assert sizes and max(sizes) <= 12
