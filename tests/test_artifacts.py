import numpy as np
import pytest
from pyspark.sql import functions as F

from series_helpers import collect_series
from cortexframe.functions.spline import spline_weights
from cortexframe.operators import artifacts as art
from cortexframe.operators import cleaning, events, ica, keyed_ica
from cortexframe.plans.blocks import to_frames


def sphere(n, seed=0):
    p = np.random.default_rng(seed).standard_normal((n, 3))
    p[:, 2] = np.abs(p[:, 2])
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def channel_table(spark, names, pos, rec="a"):
    rows = [(rec, n, "eeg", None if p is None else tuple(float(v) for v in p)) for n, p in zip(names, pos)]
    return spark.createDataFrame(rows, "recording_id string, channel string, ch_type string, pos struct<x:double,y:double,z:double>")


def test_spline_weights_reproduce_smooth_field():
    p = sphere(40)
    field = 1.0 + 0.5 * p[:, 0] - 0.3 * p[:, 2]
    w = spline_weights(p[:35], p[35:])
    assert np.allclose(w.sum(axis=1), 1, atol=1e-6)
    assert np.max(np.abs(w @ field[:35] - field[35:])) < 0.05


def test_interpolate_replaces_only_bad(spark):
    p = sphere(12)
    names = [f"c{i}" for i in range(12)]
    x = np.random.default_rng(1).standard_normal((5, 12))
    rows = [("a", t, [float(v) for v in x[t]], ["c3"] if t % 2 else []) for t in range(5)]
    df = spark.createDataFrame(rows, "recording_id string, sample_idx bigint, values array<double>, bads array<string>")
    got = np.array([r["values"] for r in art.interpolate(df, names, dict(zip(names, map(tuple, p)))).orderBy("sample_idx").collect()])
    good = [i for i in range(12) if i != 3]
    want = x.copy()
    want[1::2, 3] = x[1::2][:, good] @ spline_weights(p[good], p[[3]])[0]
    assert np.allclose(got, want)


def test_low_corr_and_noise_channels(spark, series):
    rng = np.random.default_rng(3)
    names = [f"c{i}" for i in range(8)]
    pos = sphere(7) * 0.1
    pos[2] = [0.0, 0.0, -3.0]  # far away from the others, so that it is nobody's neighbour
    base = np.cumsum(rng.standard_normal((3, 1500)), axis=1)
    mix = pos @ base * 10
    data = {("a", n): mix[i] + 0.01 * rng.standard_normal(1500) for i, n in enumerate(names[:7])}
    data["a", "c2"] = rng.standard_normal(1500) * 5
    data["a", "c7"] = mix[0]
    s = series(data)
    ch = channel_table(spark, names, [*pos, None])
    corr = {r["channel"]: r["corr"] for r in art.neighbor_correlation(s, ch).collect()}
    assert corr["c2"] < 0.5 and min(v for c, v in corr.items() if c != "c2") > 0.95
    bad = {r["channel"] for r in art.low_corr_channels(s, ch).collect()}
    assert {"c2", "c7"} <= bad and bad == {"c7"} | {c for c, v in corr.items() if v < 0.8}
    noisy = {r["channel"] for r in art.hf_noise_channels(s, 128.0).collect()}
    assert noisy == {"c2"}
    one = art.low_corr_channels(s.filter("channel = 'c0'"), ch.filter("channel = 'c0'"))
    assert one.count() == 0


def test_flat_channel(series):
    x = np.random.default_rng(0).standard_normal(1000)
    f = x.copy()
    f[100:800] = 2.0
    bad = art.flat_channels(series({("a", "x"): x, ("a", "f"): f}), 100.0)
    assert [r["channel"] for r in bad.collect()] == ["f"]


@pytest.mark.parametrize("block", [500, 20_000])
def test_r_peaks(spark, block):
    fs, n = 250.0, 5000
    t = np.arange(n) / fs
    beats = np.arange(0.6, 19.5, 0.83)
    x = 0.05 * np.sin(2 * np.pi * 0.2 * t) + 0.01 * np.random.default_rng(0).standard_normal(n)
    for b in beats:
        x += np.exp(-((t - b) / 0.012) ** 2)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "recording_id string, sample_idx bigint, value double")
    got = np.array([r["peak_idx"] for r in art.detect_r_peaks(df, fs, block).orderBy("peak_idx").collect()])
    assert len(got) == len(beats) and np.max(np.abs(got / fs - beats)) < 0.02


def test_template_subtraction_overlap(spark, series):
    x = np.arange(40.0) % 5
    peaks = spark.createDataFrame([("a", 10), ("a", 13), ("a", 1), ("a", 30)], "recording_id string, peak_idx bigint")
    got = collect_series(art.subtract_template(series({("a", "x"): x, ("a", "ecg"): x}), peaks, 3, 3, ["ecg"]), "a", "x")
    seg = [x[p - 3:p + 3] for p in (10, 13, 30)]
    want = x.copy()
    for p in (10, 13, 30):
        want[p - 3:p + 3] -= np.median(seg, axis=0)
    assert np.allclose(got, want)


def test_epoch_policy_rules(spark):
    rows = [("a", 0, False, []), ("a", 1, False, ["x"]), ("a", 2, True, ["x"]), ("a", 3, False, ["x", "y"])]
    df = spark.createDataFrame(rows, "recording_id string, epoch_idx bigint, is_bad boolean, bad_channels array<string>")
    g = spark.createDataFrame([("a", "z")], "recording_id string, channel string")
    got = [r["action"] for r in art.epoch_policy(df, g, 10, 0.2).orderBy("epoch_idx").collect()]
    assert got == ["none", "repaired", "marked_bad", "marked_bad"]


def test_clean_with_bad_channel_and_stim(spark, series):
    rng = np.random.default_rng(5)
    names = [f"c{i}" for i in range(6)]
    pos = sphere(6, 2)
    src = np.cumsum(rng.standard_normal((3, 640)), axis=1)
    x = pos @ src + 0.05 * rng.standard_normal((6, 640))
    x[1, 64 * 5:64 * 6] += 400 * rng.standard_normal(64)
    s = series({("a", n): x[i] for i, n in enumerate(names)})
    ch = channel_table(spark, names, pos)
    where = dict(zip(names, map(tuple, pos)))
    out = cleaning.clean(s, ch, names, where, 64.0, max_bad_frac=0.1)
    assert out["signals"].count() == 6 * 640
    acts = {r["epoch_idx"]: r["action"] for r in out["epochs"].collect()}
    assert len(acts) == 10
    stim = spark.createDataFrame([("a", 4.9, 6.1)], "recording_id string, start double, end double")
    kept = cleaning.clean(s, ch, names, where, 64.0, stim=stim)
    assert np.allclose(collect_series(kept["signals"], "a", "c1")[64 * 5:64 * 6], x[1, 64 * 5:64 * 6])
    aside = cleaning.clean(s, ch, names, where, 64.0, remove_bad=True, use_faster=False)
    assert aside["signals"].count() == 6 * 640


@pytest.mark.parametrize("use_ica", [False, True])
@pytest.mark.parametrize("use_faster", [False, True])
@pytest.mark.parametrize("remove_bad", [False, True])
def test_clean_keeps_every_recording_and_sample(spark, series, use_ica, use_faster, remove_bad):
    """Two recordings, one with a bad channel, plus a channel that is not EEG."""
    from cortexframe.functions.spline import spline_weights

    rng = np.random.default_rng(8)
    names, n = [f"c{i}" for i in range(6)], 512
    pos = sphere(6, 2)
    data = {(r, c): x for r in "ab" for c, x in zip(names, pos @ rng.standard_normal((3, n)) + 0.05 * rng.standard_normal((6, n)))}
    data |= {(r, "ecg"): rng.standard_normal(n) for r in "ab"}
    bads = spark.createDataFrame([("a", "c2")], "recording_id string, channel string")
    out = cleaning.clean(series(data), channel_table(spark, names, pos), names, dict(zip(names, map(tuple, pos))), 64.0,
                         use_faster=use_faster, remove_bad=remove_bad, use_ica=use_ica, bads=bads)
    rows = {(r["recording_id"], r["channel"]): r for r in out["signals"].groupBy("recording_id", "channel").agg(
        {"*": "count", "value": "count"}).collect()}
    assert set(rows) == set(data) and all(r["count(1)"] == r["count(value)"] == n for r in rows.values())
    repaired = {(r["recording_id"], r["channel"]) for r in out["repaired"].collect()}
    assert (("a", "c2") in repaired) if remove_bad else use_faster or not repaired
    for key, x in data.items():
        if key[1] == "ecg" or not use_faster and key not in repaired:
            assert np.allclose(collect_series(out["signals"], *key), x, atol=1e-8), key
    if remove_bad and not use_faster:
        good = [0, 1, 3, 4, 5]
        want = spline_weights(pos[good], pos[[2]]) @ np.stack([data["a", names[i]] for i in good])
        assert np.allclose(collect_series(out["signals"], "a", "c2"), want[0], atol=1e-8)


def test_frames_never_lose_samples(spark, series):
    s = series({("a", "x"): np.arange(3.0), ("a", "y"): np.arange(2.0)})
    rows = to_frames(s, ["x", "y"], "null").orderBy("sample_idx").collect()
    assert [r["values"] for r in rows] == [[0, 0], [1, 1], [2, None]]
    with pytest.raises(Exception, match="lacks a channel"):
        to_frames(s, ["x", "y"]).collect()


def test_ica_recovers_sources(spark):
    rng = np.random.default_rng(0)
    n = 4000
    s = np.stack([np.sign(np.sin(np.arange(n) * 0.05)), rng.laplace(size=n), rng.uniform(-1, 1, n)])
    a = rng.standard_normal((4, 3))
    x = (a @ s).T + 5
    df = spark.createDataFrame([("a", i, [float(v) for v in r]) for i, r in enumerate(x)], "recording_id string, sample_idx bigint, values array<double>").repartition(5)
    m = ica.ica_fit(df, 4, variance=None)
    y = (x - m.mean) @ m.unmixing.T
    c = np.abs(np.corrcoef(y.T, s)[:3, 3:])
    assert len(m.unmixing) == 3 and (c.max(axis=1) > 0.97).all() and len(set(c.argmax(axis=1))) == 3
    k = int(np.argmax(c[:, 1]))
    got = np.array([r["values"] for r in ica.ica_apply(df, m, [k]).orderBy("sample_idx").collect()])
    left = (got - m.mean) @ m.unmixing.T
    assert np.allclose(left[:, k], 0, atol=1e-8) and np.allclose(np.delete(left, k, 1), np.delete(y, k, 1), atol=1e-8)
    info = ica.ica_fit(df, 4, variance=None, method="infomax", max_iter=40)
    assert info.unmixing.shape == (3, 4)


def test_component_rules(spark):
    rows = [(0, "eye blink", 0.93), (1, "brain", 0.99), (2, "muscle artifact", 0.55), (3, "other", 0.8)]
    df = spark.createDataFrame(rows, "component int, label string, proba double")
    pick = lambda rule: sorted(r["component"] for r in ica.select_components(df, rule).collect())
    assert (pick("artifact"), pick("non_brain"), pick("non_brain_60")) == ([0, 2], [0, 3], [0, 3])


def test_gram(spark):
    x = np.random.default_rng(0).standard_normal((50, 3))
    df = spark.createDataFrame([("ab"[i % 2], i, [float(v) for v in r]) for i, r in enumerate(x)], "recording_id string, sample_idx bigint, values array<double>").repartition(4)
    got = {(r["recording_id"], r["i"], r["j"]): r["value"] for r in ica.gram(df, 3).collect()}
    for rec, part in (("a", x[::2]), ("b", x[1::2])):
        g = part.T @ part
        assert all(abs(got[rec, i, j] - g[i, j]) < 1e-9 for i in range(3) for j in range(3))


def brute_debounce(t, total, gap=3.0, tail=10.0):
    kept = []
    for x in sorted(t):
        if not kept or (x - kept[-1] > gap and total - x > tail):
            kept.append(x)
    return kept


def test_debounce_markers(spark):
    rng = np.random.default_rng(8)
    data = {"hot": np.round(np.cumsum(rng.choice([0.0, 0.5, 1.0, 3.0, 3.5, 9.0], 400)), 3), "b": np.array([5.0, 5.0, 8.0, 8.1, 95.0])}
    rows = [(k, float(t), f"2001 {i}", i) for k, x in data.items() for i, t in enumerate(x)]
    df = spark.createDataFrame(rows, "recording_id string, onset double, sequence string, event_id bigint")
    totals = {k: float(x.max()) + 4 for k, x in data.items()}
    out = events.debounce_markers(df, spark.createDataFrame(list(totals.items()), "recording_id string, total double"))
    got = {}
    for r in out.collect():
        got.setdefault(r["recording_id"], []).append(r["onset"])
    for k, x in data.items():
        assert sorted(got[k]) == brute_debounce(x, totals[k])


@pytest.mark.parametrize("gap,parts", [(0.0, 7), (2.0, 40), (3.0, 1), (50.0, 40), (700.0, 25)])
def test_keep_spaced_across_chunks(spark, gap, parts):
    rng = np.random.default_rng(9)
    data = {"dense": np.unique(rng.integers(0, 3000, 2500)).astype(float), "loose": np.cumsum(rng.integers(1, 60, 80)).astype(float), "one": np.array([4.0])}
    df = spark.createDataFrame([(k, float(v)) for k, x in data.items() for v in x], "k string, t double")
    got = {}
    for r in events.keep_spaced(df, ["k"], "t", gap, parts).collect():
        got.setdefault(r["k"], []).append(r["t"])
    for k, x in data.items():
        assert sorted(got[k]) == brute_debounce(x, 1e9, gap, 0.0)
    assert events.keep_spaced(df.limit(0), ["k"], "t", gap, parts).count() == 0


def test_joined_summaries_equal_a_walk():
    rng = np.random.default_rng(4)
    for _ in range(200):
        gap = float(rng.choice([0.0, 1.0, 2.5, 30.0]))
        x = np.unique(rng.integers(0, 60, rng.integers(2, 30))).astype(float)
        if len(x) < 2:
            continue
        cut = int(rng.integers(1, len(x)))
        parts = [dict(zip(("entry", "exit"), events._exits(p, gap))) for p in (x[:cut], x[cut:])]
        entry, leave = (np.asarray(v) for v in events._joined(*parts, gap))
        for state in [None, *(x[0] - np.array([0.5, 1.0, 2.0, 5.0, 31.0]))]:
            start = 0 if state is None else events._entered(x, state, gap)
            kept = events._walk(x, start, gap)
            want = x[kept[-1]] if kept else state
            assert events._after(entry, leave, state, gap) == want


@pytest.mark.parametrize("size", [7, 4096])
def test_gather_neighbors_with_gaps(spark, series, monkeypatch, size):
    from cortexframe.operators import signals as sg

    rng = np.random.default_rng(6)
    data = {("a", c): rng.standard_normal(n) for c, n in zip("uvwx", (30, 30, 22, 30))} | {("b", "u"): rng.standard_normal(5)}
    s = series(data).filter("NOT (channel = 'x' AND sample_idx % 5 = 2)")
    near = [("a", "u", 1, "w"), ("a", "u", 2, "x"), ("a", "v", 1, "u"), ("a", "x", 1, "u"), ("a", "x", 2, "gone"), ("b", "u", 1, "v")]
    table = spark.createDataFrame(near, "recording_id string, channel string, neighbor_rank bigint, neighbor string")
    have = {(r["recording_id"], r["channel"], r["sample_idx"]): r["value"] for r in s.collect()}
    want = {}
    for (rec, c, i), v in have.items():
        own = [n for r, ch, _, n in near if (r, ch) == (rec, c)]
        if own:
            want[rec, c, i] = (v, [have.get((rec, n, i)) for n in own])
    got = sg.gather_neighbors(s, table, size).collect()
    assert {(r["recording_id"], r["channel"], r["sample_idx"]): (r["value"], r["neighbor_values"]) for r in got} == want


def test_joint_rules(spark, series):
    rng = np.random.default_rng(15)
    names, n = [f"c{i}" for i in range(12)], 64 * 20
    pos = sphere(12, 2)
    x = pos @ rng.standard_normal((3, n)) + 0.2 * rng.standard_normal((12, n))
    x[[2, 5, 7, 9], 64 * 6:64 * 7] *= 40  # one bad epoch with four bad channels
    x[4, 64 * 10:64 * 11] *= 60  # one with a single bad channel stays as it is
    s = series({("a", c): x[i] for i, c in enumerate(names)})
    where = dict(zip(names, map(tuple, pos)))
    rules = cleaning.Rules(epoch_z=2.0, channel_z=1.2, min_corr=0.5, joint=True)
    out = cleaning.clean(s, channel_table(spark, names, pos), names, where, 64.0, rules=rules)
    rows = {r["epoch_idx"]: r for r in out["epochs"].collect()}
    assert "annotations" not in out and rows[6]["action"] == "interpolated" and {"c2", "c5", "c7", "c9"} <= set(rows[6]["all_bads"])
    whole = {r["channel"] for r in out["repaired"].collect()}
    for i, c in enumerate(names):
        if c not in whole:
            got, same = collect_series(out["signals"], "a", c), np.ones(n, bool)
            for e, r in rows.items():
                if r["action"] == "interpolated" and c in r["all_bads"]:
                    same[64 * e:64 * (e + 1)] = False
            assert np.allclose(got[same], x[i][same])
            if not same[64 * 6]:
                assert np.abs(got[64 * 6:64 * 7]).max() < np.abs(x[[2, 5, 7, 9], 64 * 6:64 * 7]).max() / 2


def test_pair_stim_compat(spark):
    rows = [("a", 0.0, 1.0, "Start of stimulation [1, 2]", 0), ("a", 4.0, 0.5, "End of stimulation [1, 2]", 1),
            ("a", 9.0, 0.0, "Start of stimulation [2, 2]", 2), ("a", 7.0, 0.0, "End of stimulation [2, 2]", 3), ("a", 9.5, 0.0, "Start of stimulation [3, 1]", 4)]
    df = spark.createDataFrame(rows, "recording_id string, onset double, duration double, description string, event_id bigint")
    got = [(r["start"], r["end"]) for r in events.pair_stim(df, "event_id").collect()]
    assert got == [(0.0, 4.5)]
    assert events.pair_stim(df, "event_id", strict_compat=True).count() == 0


def test_flag_epochs_boundaries(spark):
    iv = spark.createDataFrame([("a", 2.0, 3.0), ("a", 5.999, 6.0)], "recording_id string, start double, end double")
    ep = spark.createDataFrame([("a", i) for i in range(9)], "recording_id string, epoch_idx bigint")
    got = [r["epoch_idx"] for r in events.flag_epochs(ep, iv, 1.0, 100.0).filter("is_stim").orderBy("epoch_idx").collect()]
    want = [i for i in range(9) if any(i < e and i + (1 - 1 / 100) > s for s, e in ((2.0, 3.0), (5.999, 6.0)))]
    assert got == want


def test_keyed_components_equal_single_fits(spark):
    rng = np.random.default_rng(21)
    rows, data = [], {}
    for rec in ("a", "b"):
        for seg in range(3):
            x = rng.laplace(size=(700, 3)) @ rng.standard_normal((3, 4)) + 5
            data[rec, seg] = x
            rows += [(rec, seg, i + 50, v.tolist()) for i, v in enumerate(x)]
    rows += [("flat", 0, i, [1.0] * 4) for i in range(10)]
    df = spark.createDataFrame(rows, "recording_id string, segment_idx int, sample_idx bigint, values array<double>").repartition(4)
    keys = ["recording_id", "segment_idx"]
    models = keyed_ica.ica_fit_keyed(df, 4, keys)
    got = {(r["recording_id"], r["segment_idx"]): r for r in models.collect()}
    assert len(got) == 7 and got["flat", 0]["k"] == 0
    cleaned = keyed_ica.ica_apply_keyed(df.withColumn("exclude", F.array(F.lit(0))), models, keys)
    for key, x in data.items():
        own = df.filter((F.col("recording_id") == key[0]) & (F.col("segment_idx") == key[1]))
        single = ica.ica_fit(own, 4)
        model = got[key]
        assert model["converged"] and model["iterations"] == single.iterations
        assert np.allclose(np.reshape(model["unmixing"], (-1, 4)), single.unmixing, atol=1e-8)
        want = x - (x - single.mean) @ single.unmixing[[0]].T @ single.mixing[:, [0]].T
        part = cleaned.filter((F.col("recording_id") == key[0]) & (F.col("segment_idx") == key[1])).orderBy("sample_idx")
        assert np.allclose([r["values"] for r in part.collect()], want, atol=1e-7)
    flat = cleaned.filter("recording_id = 'flat'").collect()
    assert all(r["values"] == [1.0] * 4 for r in flat)
    checks = keyed_ica.model_checks(df.filter("recording_id <> 'flat'"), models.filter("k > 0"), 4, keys, 1e-3).collect()
    assert all(r["white"] and r["fixed"] and r["inverse"] for r in checks) and len(checks) == 6


@pytest.mark.parametrize("method", ["fastica", "infomax"])
def test_small_and_large_keys_get_the_models_of_single_fits(spark, monkeypatch, method):
    rng = np.random.default_rng(5)
    data = {r: rng.laplace(size=(n, 3)) @ rng.standard_normal((3, 3)) + 2 for r, n in (("a", 300), ("b", 300), ("c", 1100))}
    rows = [(r, i, v.tolist()) for r, x in data.items() for i, v in enumerate(x)] + [("flat", i, [1.0] * 3) for i in range(4)]
    df = spark.createDataFrame(rows, "recording_id string, sample_idx bigint, values array<double>").repartition(3)
    monkeypatch.setattr(keyed_ica, "WHOLE_VALUES", 900)  # so "c" takes its steps as jobs, the others in a task
    got = {r["recording_id"]: r for r in keyed_ica.ica_fit_keyed(df, 3, ["recording_id"], None, method=method).collect()}
    assert set(got) == {*data, "flat"} and (got["flat"]["k"], got["flat"]["converged"]) == (0, True)
    for r in data:
        single = ica.ica_fit(df.filter(F.col("recording_id") == r), 3, None, method=method, max_iter=2000)
        assert got[r]["converged"] and got[r]["iterations"] == single.iterations
        assert np.allclose(np.reshape(got[r]["unmixing"], (-1, 3)), single.unmixing, atol=1e-8)
        assert np.allclose(np.reshape(got[r]["mixing"], (3, -1)), single.mixing, atol=1e-8)


def test_components_are_fitted_where_samples_are_missing(spark, series):
    """Predictions stand in for missing values; what was missing stays so."""
    rng = np.random.default_rng(9)
    names, n = [f"c{i}" for i in range(5)], 200
    pos = sphere(5, 2)
    x = pos @ rng.laplace(size=(3, n)) + 0.3 * rng.standard_normal((5, n))
    x[2, 60] = np.nan
    s = series({("a", c): x[i, :150] if i == 4 else x[i] for i, c in enumerate(names)})  # one channel ends early
    s = s.withColumn("value", F.when(~((F.col("channel") == "c0") & (F.col("sample_idx") == 10)), F.col("value")))
    labels = spark.createDataFrame([(1, "muscle artifact", 0.65)], "component int, label string, proba double")
    out = cleaning.clean(s, channel_table(spark, names, pos), names, dict(zip(names, map(tuple, pos))), 64.0, use_faster=False,
                         use_ica=True, ica_labels=labels, rules=cleaning.JOINT)
    got = {(r["channel"], r["sample_idx"]): r["value"] for r in out["signals"].collect()}
    x[4, 150:] = x[0, 10] = np.nan
    full = x.copy()
    for t in np.flatnonzero(np.isnan(x).any(axis=0)):
        bad = np.flatnonzero(np.isnan(x[:, t]))
        good = np.setdiff1d(np.arange(5), bad)
        full[bad, t] = spline_weights(pos[good], pos[bad]) @ x[good, t]
    frames = spark.createDataFrame([(v.tolist(),) for v in full.T], "values array<double>")
    m = ica.ica_fit(frames, 5, None, method="infomax", max_iter=2000)
    want = (full.T - (full.T - m.mean) @ m.unmixing[[1]].T @ m.mixing[:, [1]].T).T
    assert len(got) == 5 * n
    for i, c in enumerate(names):
        for t in range(n):
            assert got[c, t] is None if np.isnan(x[i, t]) else abs(got[c, t] - want[i, t]) < 1e-6, (c, t)


@pytest.mark.parametrize("per_recording", [False, True])
def test_frames_carry_no_components_that_a_model_cannot_have(spark, monkeypatch, per_recording):
    frames = spark.createDataFrame([("a", i, [float(i), 1.0, 2.0]) for i in range(4)], "recording_id string, sample_idx bigint, values array<double>")
    picked = spark.range(5000).withColumnRenamed("id", "component")
    if per_recording:
        picked = picked.selectExpr("'a' AS recording_id", "component")
    seen = []
    monkeypatch.setattr(cleaning, "ica_apply_keyed", lambda marked, *_: seen.append(marked) or marked)
    cleaning._without(frames, frames, picked, 3)
    assert [sorted(r["exclude"]) for r in seen[0].collect()] == [[0, 1, 2]] * 4
