import numpy as np
import pytest
from pyspark.sql import functions as F

from series_helpers import collect_series
from cortexframe.functions import signal as sg
from cortexframe.functions import statespace as ss
from cortexframe.operators import aggregates as agg
from cortexframe.operators import filters as fl
from cortexframe.operators import spectra as sp
from cortexframe.operators import windows as wn


def whole_fir(x, taps):
    for t in taps:
        h = len(t) // 2
        x = np.convolve(sg.odd_extend(x, h, h), t, mode="valid")
    return x


@pytest.mark.parametrize("block", [60, 333, 5000])
def test_fir_blocks_equal_whole_record(series, block):
    rng = np.random.default_rng(2)
    x = rng.standard_normal(900)
    taps = [sg.bandpass_taps(64.0, 4.0, 12.0), sg.notch_taps(64.0, [20.0])]
    got = collect_series(fl.fir_filter(series({("a", "x"): x}), taps, block=block), "a", "x")
    assert np.allclose(got, whole_fir(x, taps), atol=1e-10)


def test_fir_response():
    fs = 128.0
    t = np.arange(4096) / fs
    for f, gain in ((10.0, 1.0), (0.02, 0.0), (60.0, 0.0)):
        y = whole_fir(np.sin(2 * np.pi * f * t), [sg.bandpass_taps(fs, 0.5, 40.0)])[1500:2500]
        assert abs(np.max(np.abs(y)) - gain) < 0.02
    y = whole_fir(np.sin(2 * np.pi * 50 * t), [sg.notch_taps(fs, [50.0])])[1500:2500]
    assert np.max(np.abs(y)) < 0.02


def test_type_dependent_taps():
    assert [len(v) for v in (fl.type_taps(250.0)[k] for k in ("eeg", "eog", "emg", "ecg"))] == [2, 2, 2, 1]
    assert len(fl.type_taps(200.0)["emg"]) == 1  # neither below nor above 200 Hz
    assert len(fl.type_taps(100.0)["eeg"]) == 1


def test_a_band_that_ends_above_the_highest_frequency_keeps_its_lower_edge():
    fs = 16.0
    t = np.arange(2048) / fs
    taps = fl.type_taps(fs, "stim")
    assert [len(taps[k]) for k in ("eeg", "eog", "emg", "ecg")] == [1, 1, 0, 1]  # EMG starts above 8 Hz
    for f, gain in ((0.0, 0.0), (0.02, 0.0), (4.0, 1.0), (7.5, 1.0)):
        y = whole_fir(np.cos(2 * np.pi * f * t), taps["eeg"])[800:1200]
        assert abs(np.max(np.abs(y)) - gain) < 0.02


def test_a_missing_sample_leaves_the_others_of_its_series(spark, series):
    rng = np.random.default_rng(6)
    x, n = rng.standard_normal(32), 32
    types = spark.createDataFrame([("a", "x", "eeg"), ("a", "y", "eeg")], "recording_id string, channel string, ch_type string")
    s = series({("a", "x"): x, ("a", "y"): x}).withColumn(
        "value", F.when(~((F.col("channel") == "x") & F.col("sample_idx").isin(7, 8)), F.col("value")))
    out = fl.filter_detrend(s, types, 16.0, "stim")
    got = collect_series(out, "a", "x")
    x[7:9] = x[6] + (x[9] - x[6]) * np.array([1, 2]) / 3
    y, t = whole_fir(x, fl.type_taps(16.0, "stim")["eeg"]), np.setdiff1d(np.arange(n), [7, 8])
    line = np.polyfit(t, y[t], 1)
    assert [i for i, v in enumerate(got) if v is None or np.isnan(v)] == [7, 8]
    assert np.allclose(got[t].astype(float), y[t] - np.polyval(line, t), atol=1e-9)
    assert all(v is not None and np.isfinite(v) for v in collect_series(out, "a", "y"))


def direct_filtfilt(x, b, a):
    """Plain recursion with odd padding and steady-state start."""
    n = max(len(a), len(b))
    b, a = np.pad(b, (0, n - len(b))), np.pad(a, (0, n - len(a)))

    def run(v):
        long = np.concatenate([np.full(4000, v[0]), v])
        z, out = np.zeros(n), np.zeros(len(long))
        for i, u in enumerate(long):
            y = b[0] * u + z[0]
            for k in range(1, n):
                z[k - 1] = b[k] * u + z[k] - a[k] * y
            out[i] = y
        return out[4000:]

    pad = 3 * n
    ext = sg.odd_extend(x, pad, pad)
    return run(run(ext)[::-1])[::-1][pad:-pad]


@pytest.mark.parametrize("block", [70, 4000])
@pytest.mark.parametrize("order,band", [(4, (20.0, None)), (4, (None, 30.0)), (2, (8.0, 30.0))])
def test_butterworth(series, block, order, band):
    x = np.random.default_rng(4).standard_normal(500)
    b, a = sg.butter_sections(order, band, 128.0)
    got = collect_series(fl.butter_filtfilt(series({("a", "x"): x}), 128.0, order, band, block), "a", "x")
    assert np.allclose(got, direct_filtfilt(x, b, a), atol=1e-9)


def cascade_filtfilt(x, sections, pad):
    """Section by section and sample by sample, with odd padding and steady-state start."""
    def run(y):
        for b0, b1, b2, a1, a2 in sections:
            into = np.array([b1 - a1 * b0, b2 - a2 * b0])
            z = np.linalg.solve(np.eye(2) - np.array([[-a1, 1.0], [-a2, 0.0]]), into) * y[0]
            out = np.empty(len(y))
            for i, v in enumerate(y):
                out[i] = b0 * v + z[0]
                z = np.array([b1 * v - a1 * out[i] + z[1], b2 * v - a2 * out[i]])
            y = out
        return y

    pad = min(pad, len(x) - 1)
    return run(run(sg.odd_extend(x, pad, pad))[::-1])[::-1][pad:pad + len(x)]


@pytest.mark.parametrize("order,band,pad", [(2, (0.1, None), 9), (4, (0.1, None), 15), (2, (0.1, 40.0), 15), (5, (0.5, None), 18), (3, (1.0, 60.0), 21)])
def test_slow_filters_exchange_states(series, order, band, pad):
    """The response outlasts many blocks; series of one, few and many blocks, short last blocks, a late start."""
    rng = np.random.default_rng(6)
    data = {("a", str(n)): np.cumsum(rng.standard_normal(n)) for n in (1, 2, 30, 64, 65, 130, 1001, 3000)}
    frame = series(data)
    late = frame.filter("channel = '1001'").selectExpr("'late' AS recording_id", "channel", "sample_idx + 100 AS sample_idx", "value")
    got = fl.butter_filtfilt(frame.unionByName(late), 128.0, order, band, 64).cache()
    sections = ss.butter_sos(order, band, 128.0)
    for (rec, ch), x in data.items():
        assert np.allclose(collect_series(got, rec, ch), cascade_filtfilt(x, sections, pad), rtol=0, atol=1e-9 * max(1, np.abs(x).max()))
    assert np.allclose(collect_series(got, "late", "1001"), cascade_filtfilt(data["a", "1001"], sections, pad), rtol=0, atol=1e-9 * np.abs(data["a", "1001"]).max())


def test_butterworth_sections():
    w = np.exp(1j * np.linspace(0.05, 3.1, 40))
    for order, band in ((1, (None, 30.0)), (3, (10.0, None)), (4, (8.0, 30.0)), (3, (1.0, 60.0)), (5, (None, 5.0))):
        b, a = sg.butter_sections(order, band, 128.0)
        whole = np.polyval(b, w) / np.polyval(a, w) * w ** (len(a) - len(b))
        parts = np.prod([np.polyval(s[:3], w) / np.polyval((1.0, *s[3:]), w) for s in ss.butter_sos(order, band, 128.0)], axis=0)
        assert np.allclose(whole, parts, atol=1e-9)


def test_butterworth_half_power():
    b, a = sg.butter_sections(4, (None, 30.0), 128.0)
    z = np.exp(-2j * np.pi * 30.0 / 128.0 * np.arange(len(b)))
    assert abs(abs((b @ z) / (a @ z)) - np.sqrt(0.5)) < 1e-9


@pytest.mark.parametrize("block", [50, 2000])
def test_bandlimited_resampling(series, block):
    fs, fs2, n = 200.0, 128.0, 1000
    x = np.sin(2 * np.pi * 13.0 * np.arange(n) / fs)
    got = collect_series(fl.resample_bandlimited(series({("a", "x"): x}), fs, fs2, block=block), "a", "x")
    want = np.sin(2 * np.pi * 13.0 * np.arange(640) / fs2)
    assert len(got) == 640
    assert np.max(np.abs(got - want)[60:-60]) < 1e-3
    up = collect_series(fl.resample_bandlimited(series({("a", "x"): want}), fs2, 250.0, block=block), "a", "x")
    assert len(up) == 1250 and np.max(np.abs(up - np.sin(2 * np.pi * 13.0 * np.arange(1250) / 250.0))[100:-100]) < 1e-3


@pytest.mark.parametrize("chunk", [3, 1000])
@pytest.mark.parametrize("fs2", [7.0, 16.0, 33.3])
def test_linear_resampling(series, chunk, fs2):
    x = np.random.default_rng(1).standard_normal(101)
    got = collect_series(fl.resample_linear(series({("a", "x"): x}), 16.0, fs2, chunk=chunk), "a", "x")
    n2 = int(101 / 16.0 * fs2)
    want = np.interp(np.arange(n2) * 101 / n2, np.arange(101), x)
    assert np.allclose(got, want, atol=1e-9)


def test_resample_record_drops_nan_channel(series):
    x = np.random.default_rng(1).standard_normal(300)
    bad = x.copy()
    bad[7] = np.nan
    out = fl.resample_record(series({("a", "x"): x, ("a", "y"): bad}), 100.0, 64.0)
    assert [r["channel"] for r in out.select("channel").distinct().collect()] == ["x"]
    got = collect_series(out, "a", "x")
    assert len(got) == 192 and abs(got.mean()) < 1e-9 and abs(got.std() - 1) < 1e-9


def welch(x, fs, n, window):
    step = n - n // 2
    segs = [x[i:i + n] for i in range(0, len(x) - n + 1, step)]
    w = window(n)
    p = np.mean([np.abs(np.fft.rfft((s - s.mean()) * w)) ** 2 for s in segs], axis=0) / (fs * (w**2).sum())
    p[1:-1 if n % 2 == 0 else None] *= 2
    return p


@pytest.mark.parametrize("block", [64, 90, 5000])
@pytest.mark.parametrize("n", [64, 51])
def test_welch_block_invariance(series, block, n):
    x = np.random.default_rng(1).standard_normal(700)
    rows = sp.welch_psd(series({("a", "x"): x}), 64.0, n, fmax=100.0, block=block).orderBy("freq").collect()
    assert np.allclose([r["power"] for r in rows], welch(x, 64.0, n, sg.hann))


@pytest.mark.parametrize("block", [8, 16, 20, 64])
def test_welch_short_record(series, block):
    x = np.random.default_rng(1).standard_normal(20)
    rows = sp.welch_psd(series({("a", "x"): x}), 64.0, 32, fmax=100.0, block=block).orderBy("freq").collect()
    assert len(rows) == 11 and np.allclose([r["power"] for r in rows], welch(x, 64.0, 20, sg.hann))
    assert sp.spectrogram(series({("a", "x"): x}), 64.0, 32, 16, block=block).select("time").distinct().count() == 1


def test_to_db_of_zero(spark):
    assert spark.range(1).select(sp.to_db(F.lit(0.0)).alias("x")).first()["x"] == float("-inf")


def test_detrend_and_standardize(series):
    x = 3 + 0.25 * np.arange(100) + np.sin(np.arange(100))
    s = series({("a", "x"): x, ("a", "c"): np.full(100, 4.0)})
    got = collect_series(fl.detrend_linear(s), "a", "x")
    fit = np.polyval(np.polyfit(np.arange(100), x, 1), np.arange(100))
    assert np.allclose(got, x - fit)
    z = agg.standardize(s)
    assert np.allclose(collect_series(z, "a", "x"), (x - x.mean()) / x.std())
    assert np.allclose(collect_series(z, "a", "c"), 0)


@pytest.mark.parametrize("chunk", [2, 5, 1000])
def test_local_maxima_and_flat_runs(series, chunk):
    x = [0, 2, 1, 3, 3, 1, 5, 4, 4, 6, 0]
    got = wn.local_maxima(series({("a", "x"): x}), chunk=chunk).orderBy("sample_idx").collect()
    assert [r["sample_idx"] for r in got] == [1, 6, 9]
    flat = np.concatenate([np.zeros(12), np.arange(8), np.ones(20), np.arange(4), np.ones(3)])
    s = series({("a", "x"): flat, ("a", "y"): np.arange(47)})
    longest = {r["channel"]: r["longest"] for r in wn.longest_flat_run(s, 4, chunk=chunk).collect()}
    assert longest == {"x": 5, "y": 0}


def test_savgol_lengths(spark):
    rows = [("k7", f, float(v)) for f, v in enumerate([1, 4, 2, 8, 5, 7, 1])] + [("k6", f, float(f * f * f)) for f in range(6)] + [("k3", f, float(f)) for f in range(3)]
    df = spark.createDataFrame(rows, "k string, freq int, power_db double")
    got = {}
    for r in wn.savgol(df, ["k"]).orderBy("freq").collect():
        got.setdefault(r["k"], []).append(r["power_db"])
    y = np.array([1, 4, 2, 8, 5, 7, 1.0])
    assert np.allclose(got["k7"], np.polyval(np.polyfit(np.arange(7), y, 3), np.arange(7)))
    assert np.allclose(got["k6"], [f**3 for f in range(6)]) and got["k3"] == [0, 1, 2]
