import datetime

import numpy as np

from cortexframe.operators import cleaning, events
from cortexframe.operators import stimulation as stm
from test_artifacts import channel_table, sphere


def test_cut_windows_may_overlap(spark, series):
    data = {("a", "x"): np.arange(100.0), ("a", "y"): np.arange(100.0) + 1000, ("b", "x"): np.arange(50.0)}
    rows = [("a", "before", 0, 1.0, 3.0), ("a", "after", 0, 2.5, 4.55), ("a", "before", 1, 9.0, 12.0), ("b", "before", 0, -1.0, 0.3), ("c", "after", 0, 0.0, 1.0)]
    windows = spark.createDataFrame(rows, "recording_id string, condition string, segment_idx bigint, tmin double, tmax double")
    got = {}
    for r in stm.cut_windows(series(data), windows, 10.0).collect():
        got.setdefault((r["recording_id"], r["condition"], r["segment_idx"], r["channel"]), {})[r["sample_idx"]] = r["value"]
    want = {}
    for rec, cond, seg, lo, hi in rows:
        for (other, c), x in data.items():
            part = x[max(int(lo * 10), 0):int(hi * 10)]
            if other == rec and len(part):
                want[rec, cond, seg, c] = dict(enumerate(part))
    assert got == want
    assert stm.cut_windows(series(data), windows.limit(0), 10.0).count() == 0


def test_windows_are_cleaned_one_by_one(spark, series):
    rng = np.random.default_rng(3)
    names, n = [f"c{i}" for i in range(8)], 640
    pos = sphere(8, 2)
    x = pos @ rng.laplace(size=(3, n)) + 0.2 * rng.standard_normal((8, n))
    x[[1, 3, 6], 64 * 3:64 * 4] *= 30
    s = series({("a", c): x[i] for i, c in enumerate(names)})
    ch, where = channel_table(spark, names, pos), dict(zip(names, map(tuple, pos)))
    rows = [("a", "before", 0, 0.0, 5.0), ("a", "after", 0, 5.0, 10.0)]
    windows = spark.createDataFrame(rows, "recording_id string, condition string, segment_idx bigint, tmin double, tmax double")
    rules = cleaning.Rules(epoch_z=1.5, channel_z=1.2, min_corr=0.5, joint=True)
    labels = spark.createDataFrame([("a", "before", 0, 0, "eye blink", 0.9)],
                                   "recording_id string, condition string, segment_idx bigint, component int, label string, proba double")
    out = stm.clean_windows(stm.cut_windows(s, windows, 64.0), ch, names, where, 64.0, filtered=False, rules=rules, use_ica=True, ica_labels=labels)
    got = {(r["condition"], r["channel"], r["sample_idx"]): r["value"] for r in out["signals"].collect()}
    assert len(got) == 8 * n
    for _, cond, _, lo, hi in rows:
        alone = series({("w", c): x[i, int(lo * 64):int(hi * 64)] for i, c in enumerate(names)})
        one = labels.selectExpr("'w' AS recording_id", "component", "label", "proba") if cond == "before" else None
        single = cleaning.clean(alone, ch.selectExpr("'w' AS recording_id", "channel", "ch_type", "pos"), names, where, 64.0,
                                rules=rules, use_ica=True, ica_labels=one)["signals"].collect()
        assert len(single) == 8 * 320
        assert max(abs(got[cond, r["channel"], r["sample_idx"]] - r["value"]) for r in single) < 1e-6
    assert any(abs(got["before", c, t] - x[i, t]) > 1e-3 for i, c in enumerate(names) for t in range(64))


def test_cleaning_gathers_frames_once(spark, series, monkeypatch):
    calls = []
    frames = cleaning.to_frames
    monkeypatch.setattr(cleaning, "to_frames", lambda *a: calls.append(1) or frames(*a))
    names, n = [f"c{i}" for i in range(6)], 64
    pos = sphere(6, 2)
    x = np.random.default_rng(1).standard_normal((6, n))
    x[[1, 3], 16:32] *= 40
    s = series({("a", c): x[i] for i, c in enumerate(names)})
    rules = cleaning.Rules(epoch_z=1.0, channel_z=1.0, min_corr=0.5, joint=True)
    out = cleaning.clean(s, channel_table(spark, names, pos), names, dict(zip(names, map(tuple, pos))), 16.0, rules=rules)
    got = {(r["channel"], r["sample_idx"]): r["value"] for r in out["signals"].collect()}
    assert len(got) == 6 * n and len(calls) == 1


def test_texts_look_for_segments_in_stretches_of_their_length(spark, monkeypatch):
    widths = []
    inside = events.annotations_in_segment
    monkeypatch.setattr(events, "annotations_in_segment", lambda a, s, width: widths.append(width) or inside(a, s, width))
    segments = spark.createDataFrame([("a", i, 3.0 * i, 3.0 * i + 3.0) for i in range(50)], "recording_id string, seg_idx bigint, seg_start double, seg_end double")
    texts = [("a", i, 3.0 * i + 1, 0.0, "Start of stimulation") for i in range(50)]
    got = events.before_after_tasks(segments, spark.createDataFrame(texts, "recording_id string, event_id bigint, onset double, duration double, description string"), (0.0, 1.0), (0.0, 1.0))
    assert sorted((r["seg_idx"], r["tmin"]) for r in got.collect()) == [(i, 3.0 * i) for i in range(50)]
    assert widths == [3.0]


def test_the_cleaned_report_takes_components_out(spark, tmp_path):
    """Two labelings of the components of the same events: all brain, and one that is not."""
    from cortexframe.queries import stimulation_q

    rng = np.random.default_rng(4)
    kinds, start = ["error", "signup", "purchase", "view", "click"], datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=i), 0, kinds[i % 5], float(v)) for i, v in enumerate(rng.laplace(size=2400))]
    got = {}
    for name, size in (("brain", 7), ("muscle", 2)):  # p_size picks the class, p_partkey the probability: 0.74 for 2
        sf = str(tmp_path / name)
        spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").write.parquet(f"{sf}/events.parquet")
        spark.createDataFrame([(2, size)], "p_partkey bigint, p_size int").write.parquet(f"{sf}/part.parquet")
        got[name] = {(r["channel"], r["freq"]): (r["n"], r["t"]) for r in stimulation_q.cleaned(spark, sf).collect()}
    assert got["brain"].keys() == got["muscle"].keys() and len(got["brain"]) == 45
    assert all(n > 1 for n, _ in got["muscle"].values())
    assert sum(abs(got["brain"][k][1] - got["muscle"][k][1]) > 1e-3 for k in got["brain"]) > 20
