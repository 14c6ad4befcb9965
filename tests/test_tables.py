import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cortexframe.functions.channels import channel_type, natural_key
from cortexframe.functions.stats import beta_inc, t_two_sided
from cortexframe.operators import archive as ar
from cortexframe.operators import channels as ch
from cortexframe.operators import classifier as cl
from cortexframe.operators import dataset as ds
from cortexframe.operators import stats as st
from cortexframe.sources import edf
from cortexframe.sources import files as src
from cortexframe.sources import tables as tb


def test_channel_types(spark):
    want = {
        "EEG Fpz-Cz": "eeg", "C3-M2": "eeg", "EOG(L)": "eog", "EKG_L-Cz": "ecg", "CHIN2-C": "misc", "SpO2-0": "misc", "EMG submental": "emg",
        "EEG ECG": "eeg", "EMG-ECG": "emg", "Heart rate": "ecg", "HEOG": "eog", "fp1ref": "eeg", "XF3": "misc", "1F3": "eeg", "FTT9h": "misc",
        "F3-C3": "eeg", "LeftEye": "eog", "": "misc", "Muscle": "emg", "CZA1": "eeg", "T3T4": "eeg",
    }
    df = spark.createDataFrame([(k,) for k in want], "c string").select("c", channel_type(F.col("c")).alias("t"), channel_type(F.col("c"), "simple").alias("s"))
    got = {r["c"]: r["t"] for r in df.collect()}
    assert got == want
    simple = {r["c"]: r["s"] for r in df.collect()}
    assert simple["fp1ref"] == "misc" and simple["C3-M2"] == "eeg"


def test_natural_order(spark):
    names = ["f10", "f2", "f2b", "f02", "g1", "f1_9", "f1_10"]
    df = spark.createDataFrame([(n,) for n in names], "n string").orderBy(natural_key(F.col("n")), "n")
    assert [r["n"] for r in df.collect()] == ["f1_9", "f1_10", "f02", "f2", "f2b", "f10", "g1"]


def test_t_distribution():
    assert np.allclose(t_two_sided([0.0, 2.0, -12.706204736], [5, 10, 1]), [1.0, 0.07338803477074, 0.05], atol=1e-9)
    assert np.isnan(t_two_sided([np.nan], [3])[0]) and t_two_sided([np.inf], [3])[0] == 0
    x = np.linspace(0.01, 0.99, 9)
    assert np.allclose(beta_inc(2, 3, x), 6 * x**2 - 8 * x**3 + 3 * x**4)


def test_paired_test_edge_cases(spark):
    rows = [("a", "x", 1.0, 0, 1.0, 2.0), ("a", "x", 1.0, 1, 2.0, 4.0), ("a", "x", 1.0, 2, 0.0, 0.5), ("a", "x", 2.0, 0, 1.0, 2.0), ("a", "x", 2.0, 1, float("nan"), 2.0)]
    df = spark.createDataFrame(rows, "recording_id string, channel string, freq double, segment_idx int, before_db double, after_db double")
    got = {r["freq"]: r for r in st.paired_ttest(df).collect()}
    d = np.array([1.0, 2.0, 0.5])
    assert abs(got[1.0]["t"] - d.mean() / (d.std(ddof=1) / np.sqrt(3))) < 1e-12
    assert got[2.0]["p"] == 1.0 and got[2.0]["n"] == 1
    p = [0.001, 0.04, 0.03, 0.5]
    t = spark.createDataFrame([("a", "x", float(i), v) for i, v in enumerate(p)], "recording_id string, channel string, freq double, p double")
    adj = [r["p_adj"] for r in st.fdr_bh(t).orderBy("freq").collect()]
    assert np.allclose(adj, [0.004, 0.04 * 4 / 3, 0.04 * 4 / 3, 0.5])


def write_edf(path, signals, fs, records, bdf=False, notes=()):
    """A small EDF+/BDF file for the reader test."""
    width, top = (3, 2**23 - 1) if bdf else (2, 2**15 - 1)
    names = list(signals) + ([("BDF" if bdf else "EDF") + " Annotations"] if notes else [])
    per = [fs] * len(signals) + ([60] if notes else [])
    head = (b"\xffBIOSEMI" if bdf else b"0".ljust(8)) + b"x".ljust(80) + b"y".ljust(80) + b"02.03.2010.11.12"[:0] + b"02.03.10" + b"10.11.12"
    ns = len(names)
    head += str(256 * (ns + 1)).encode().ljust(8) + b"".ljust(44) + str(records).encode().ljust(8) + b"1".ljust(8) + str(ns).encode().ljust(4)
    col = lambda vals, n: b"".join(str(v).encode().ljust(n) for v in vals)
    head += col(names, 16) + col([""] * ns, 80) + col(["uV"] * len(signals) + [""] * bool(notes), 8) + col([-200] * ns, 8) + col([200] * ns, 8)
    head += col([-top - 1] * ns, 8) + col([top] * ns, 8) + col([""] * ns, 80) + col(per, 8) + col([""] * ns, 32)
    body = b""
    for r in range(records):
        for x in signals.values():
            dig = np.round((x[r * fs:(r + 1) * fs] + 200) / 400 * (2 * top + 1) - top - 1).astype(int)
            body += b"".join(int(d).to_bytes(width, "little", signed=True) for d in dig)
        if notes:
            tal = f"+{r}\x14\x14\x00".encode() + b"".join(f"+{t}\x15{d}\x14{text}\x14\x00".encode() for t, d, text in notes if int(t) == r)
            body += tal.ljust(60 * width, b"\x00")
    path.write_bytes(head + body)


@pytest.mark.parametrize("bdf", [False, True])
def test_read_edf(spark, tmp_path, bdf):
    rng = np.random.default_rng(0)
    data = {"Fz": rng.uniform(-150, 150, 700), "Cz": rng.uniform(-150, 150, 700)}
    name = "rec1.BDF" if bdf else "rec1.edf"
    (tmp_path / "s").mkdir()
    write_edf(tmp_path / "s" / name, data, 100, 7, bdf, [(1.5, 2.0, "Start of stimulation [1, 2]"), (4.0, 0, "2001 3")])
    for split in (300, 1 << 20):
        rows = edf.read_edf(spark, str(tmp_path), block_seconds=2.0, split_bytes=split).collect()
        assert len(rows) == 8
        for ch, x in data.items():
            got = np.concatenate([r["samples"] for r in sorted(rows, key=lambda r: r["block_idx"]) if r["channel"] == ch])
            assert np.allclose(got * 1e6, x, atol=0.01 if not bdf else 1e-4) and rows[0]["fs"] == 100.0
        assert {r["start_sample"] for r in rows} == {0, 200, 400, 600}
    only = edf.read_edf(spark, str(tmp_path), ["Cz"])
    assert {r["channel"] for r in only.collect()} == {"Cz"}
    ch = edf.read_edf_channels(spark, str(tmp_path)).orderBy("channel_order").collect()
    assert [(r["channel"], r["n_samples"], r["units"], r["meas_date"].year) for r in ch] == [("Fz", 700, "uV", 2010), ("Cz", 700, "uV", 2010)]
    ann = edf.read_edf_annotations(spark, str(tmp_path)).orderBy("onset").collect()
    assert [(r["onset"], r["duration"], r["description"]) for r in ann] == [(1.5, 2.0, "Start of stimulation [1, 2]"), (4.0, 0.0, "2001 3")]
    assert struct.calcsize("<h") == 2


def test_wfdb_headers(spark, tmp_path):
    (tmp_path / "a.hea").write_text("tr03-0005 4 200 5147000\ntr03-0005.mat 16+24 1/uV 16 0 -9 139 0 F3-M2\nx y 2.5/uV 0 0 0 0 0 F4\n x y zz/uV 0 0 0 0 0 C3\n")
    rows = src.read_wfdb_headers(spark, str(tmp_path)).orderBy("channel_order").collect()
    assert [(r["channel"], r["gain"]) for r in rows] == [("F3-M2", 1.0), ("F4", 2.5), ("C3", 1.0), ("EEG4", 1.0)]
    assert rows[0]["recording_id"] == "tr03-0005" and rows[0]["n_samples"] == 5147000


def test_manifests_and_listing(spark, tmp_path):
    (tmp_path / "split.json").write_text(json.dumps({"train": ["a", "b"], "val": ["c"]}))
    got = {(r["split"], r["position"], r["file"]) for r in src.read_split_manifest(spark, str(tmp_path / "split.json")).collect()}
    assert got == {("train", 0, "a"), ("train", 1, "b"), ("val", 0, "c")}
    (tmp_path / "mod.json").write_text(json.dumps({"BAS": ["C3", "C4", "C4"], "EKG": ["ECG"], "EMG": ["EMG"]}))
    mod = src.read_modality_map(spark, str(tmp_path / "mod.json"), ["EMG", "BAS"]).collect()
    assert sorted((r["modality"], r["channel"]) for r in mod) == [("BAS", "C3"), ("BAS", "C4"), ("EMG", "EMG")]
    for f in ("s2/run_10.bdf", "s2/run_9.EDF", "s10/a.fif", "s10/b.txt"):
        p = tmp_path / "data" / f
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"1")
    files = src.discover_recordings(spark, str(tmp_path / "data"))
    assert [r["file_path"].rsplit("/", 2)[-2:] for r in files.orderBy("position").collect()] == [["s2", "run_9.EDF"], ["s2", "run_10.bdf"], ["s10", "a.fif"]]
    sess = {r["session"]: (r["subject_offset"], r["n_files"]) for r in src.list_sessions(files, str(tmp_path / "data")).collect()}
    assert sess == {"s2": (0, 2), "s10": (1, 1)}


def test_hypnograms_by_path(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "night1.csv").write_text("sleep_stage\n" + "\n".join("0011234") + "\n")
    (tmp_path / "night2.csv").write_text("sleep_stage,other\n4,a\n0,b\n")
    rows = src.read_hypnograms(spark, str(tmp_path)).orderBy("recording_id", "epoch_idx").collect()
    assert [(r["recording_id"], r["epoch_idx"], r["sleep_stage"]) for r in rows][:2] == [("night2", 0, 4), ("night2", 1, 0)]
    assert [r["sleep_stage"] for r in rows if r["recording_id"] == "x/night1"] == [0, 0, 1, 1, 2, 3, 4]


def test_registry_and_archive_text(spark, tmp_path):
    info = [{"name": "A", "file_count": 2, "planned_start_subject_id": "0000001", "planned_end_subject_id": "0000002", "creation_time": "t", "task": "sleep", "session": "ses-1", "total_recording_hours": 1.5}]
    (tmp_path / "r.json").write_text(json.dumps({"Name": "X", "DatasetInfo": info}, indent=2))
    reg = src.read_dataset_registry(spark, str(tmp_path / "r.json"))
    assert reg.first().asDict() == info[0]
    summary = ar.dataset_summary(reg, "A").first()
    assert summary["range_ok"] and summary["is_current"]
    rec = spark.createDataFrame([("a", 100.0, 501)], "recording_id string, fs double, n_samples bigint")
    ch = spark.createDataFrame([("a", "C3", "EEG"), ("a", "t", "TRIG"), ("a", "m", None)], "recording_id string, channel string, ch_type string")
    side = json.loads(ar.sidecar_json(ar.processed_sidecar(ar.sidecar(rec, ch, "sleep"), "d", "f", "now")).first()["json"])
    assert side["EEGChannelCount"] == 1 and side["MiscChannelCount"] == 2 and side["TriggerChannelCount"] == 1
    assert side["RecordingDuration"] == 5.0 and len(side["ProcessingSteps"]) == 5
    log = spark.createDataFrame([(0, "/x/a.edf", "success", "success", 3600.0, None), (1, "/x/b.edf", "failed", "skipped", 10.0, "e" * 200)],
                                "idx bigint, file_path string, process_status string, copy_status string, recording_duration double, error string")
    lines = [r["line"] for r in ar.processing_report(log, "R", "now").collect()]
    assert lines[1] == "- Files: 2" and lines[-1].endswith("error: " + "e" * 100) and "a.edf 3600.0 s (1.00 h)" in lines[-2]
    tb.write_processing_log(ar.processing_report(log, "R", "now"), str(tmp_path / "log"))
    tb.write_channels_sheet(ch.na.fill("MISC"), str(tmp_path / "sheet"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "sheet")).count() == 3
    assert spark.range(1).select(ar.session_label(F.lit("ses_1-b"))).first()[0] == "ses1b"
    assert spark.range(1).select(ar.subject_label(F.lit(12345678))).first()[0] == "12345678"


def test_block_mask_invariants(spark):
    m = ds.block_mask(spark.range(200).withColumnRenamed("id", "sample_id"), 15, 0.5, seed=3)
    rows = m.collect()
    for r in rows:
        assert sum(v == 0 for v in r["mask"]) == 7 and sorted(r["context"] + r["target"]) == list(range(15))
        assert all(r["mask"][i] == 0 for i in r["target"])
    again = ds.block_mask(spark.range(200).withColumnRenamed("id", "sample_id").repartition(9), 15, 0.5, seed=3).collect()
    assert {r["sample_id"]: r["mask"] for r in rows} == {r["sample_id"]: r["mask"] for r in again}
    assert len({tuple(r["mask"]) for r in rows}) > 50


def test_kfold_sizes(spark):
    df = spark.createDataFrame([(f"r{i % 9}", i) for i in range(103)], "recording_id string, epoch_idx bigint")
    n = {r["fold"]: r["count"] for r in ds.kfold(df, 5).groupBy("fold").count().collect()}
    assert n == {0: 20, 1: 20, 2: 20, 3: 20, 4: 23}
    by = ds.kfold(df, 3, by="recording").groupBy("recording_id").agg(F.count_distinct("fold").alias("n")).collect()
    assert len(by) == 9 and all(r["n"] == 1 for r in by)


def test_classifier_learns_separable_stages(spark):
    rng = np.random.default_rng(0)
    rows = [("r", i, float(i % 3 + 0.1 * rng.standard_normal()), float(-(i % 3) + 0.1 * rng.standard_normal())) for i in range(150)]
    feats = spark.createDataFrame(rows, "recording_id string, epoch_idx bigint, delta double, theta double")
    stages = feats.select("recording_id", "epoch_idx", (F.col("epoch_idx") % 3).alias("sleep_stage"))
    pred, per_fold = cl.stage_classifier_cv(feats, stages, 3, 3)
    assert pred.count() == 150 and per_fold.agg(F.min("accuracy")).first()[0] > 0.9


class CountingFile:
    def __init__(self, path):
        self.inner, self.bytes = open(path, "rb"), 0

    def seek(self, at):
        self.inner.seek(at)

    def read(self, n):
        got = self.inner.read(n)
        self.bytes += len(got)
        return got


def test_edf_reads_only_wanted_bytes(spark, tmp_path):
    rng = np.random.default_rng(2)
    data = {f"C{i}": rng.uniform(-150, 150, 2000) for i in range(6)}
    notes = [(3.5, 1.0, "lights off"), (8.0, 0, "2001 1")]
    write_edf(tmp_path / "r.edf", data, 200, 10, False, notes)
    size = (tmp_path / "r.edf").stat().st_size
    f = CountingFile(tmp_path / "r.edf")
    head = edf.parse_header(f, size)
    whole = edf.read_records(f, head, head.data_at, 10, list(range(7)), 1)
    f.bytes = 0
    part = edf.read_records(f, head, head.data_at, 10, [1, 4], 300)
    assert f.bytes == 10 * 2 * 400 and all((part[i] == whole[i]).all() for i in (1, 4))
    f.bytes = 0
    text = edf.read_records(f, head, head.data_at, 10, [6], 300)
    assert f.bytes == 10 * 120 and (text[6] == whole[6]).all()
    f.bytes = 0
    edf.read_records(f, head, head.data_at, 10, [1, 4], 1 << 20)  # small gaps are read over
    assert f.bytes == 10 * head.record_bytes
    rows = edf.read_edf(spark, str(tmp_path), ["C4", "C1"], block_seconds=3.0, split_bytes=5000, min_skip=300).collect()
    for c in ("C1", "C4"):
        got = np.concatenate([r["samples"] for r in sorted(rows, key=lambda r: r["block_idx"]) if r["channel"] == c])
        assert np.allclose(got * 1e6, data[c], atol=0.01)
    ann = edf.read_edf_annotations(spark, str(tmp_path), min_skip=300).orderBy("onset").collect()
    assert [(r["onset"], r["description"]) for r in ann] == [(3.5, "lights off"), (8.0, "2001 1")]
    assert edf.read_edf(spark, str(tmp_path), ["none"]).count() == 0


def test_streams_of_work_resume(spark):
    tasks = spark.createDataFrame([("a",), ("b",)], "file string")
    assert [r["file"] for r in tb.skip_done(tasks, tasks.filter("file = 'a'"), ["file"]).collect()] == ["b"]


def test_same_stem_in_two_folders(spark, tmp_path):
    for session in ("s1", "s2"):
        (tmp_path / session).mkdir()
        write_edf(tmp_path / session / "night.bdf", {"Cz": np.arange(200.0)}, 100, 2, True)
        (tmp_path / session / "night.csv").write_text("sleep_stage\n1\n2\n")
    rows = edf.read_edf(spark, str(tmp_path), block_seconds=1.0).collect()
    assert sorted((r["recording_id"], r["block_idx"]) for r in rows) == [(f"{s}/night", b) for s in ("s1", "s2") for b in (0, 1)]
    from cortexframe.sources.files import read_hypnograms

    got = sorted((r["recording_id"], r["epoch_idx"], r["sleep_stage"]) for r in read_hypnograms(spark, str(tmp_path)).collect())
    assert got == [(f"{s}/night", i, i + 1) for s in ("s1", "s2") for i in (0, 1)]


def test_sinks_replace_what_they_wrote(spark, tmp_path):
    from cortexframe.sources import tables

    blocks = spark.createDataFrame([("1", "x", 0, 0, [1.0]), ("2", "x", 0, 0, [2.0])], "recording_id string, channel string, block_idx bigint, start_sample bigint, samples array<double>")
    for _ in range(2):
        tables.write_blocks(blocks, f"{tmp_path}/blocks")
    tables.write_blocks(blocks.filter("recording_id = '1'"), f"{tmp_path}/blocks")
    got = tables.read_blocks(spark, f"{tmp_path}/blocks")
    assert sorted((r["recording_id"], r["samples"]) for r in got.collect()) == [("1", [1.0]), ("2", [2.0])]


def test_many_rows_in_few_bytes_make_many_chunks(spark):
    from cortexframe.plans.chunks import CHUNK, CHUNK_SAMPLES, range_chunks

    n = 20 * CHUNK_SAMPLES
    table = spark.range(n).selectExpr("'a' as recording_id", "id as sample_idx", "1 as label")
    per = range_chunks(table, ["recording_id"], ["sample_idx"]).groupBy(CHUNK).count().collect()
    assert len(per) >= 15 and max(r["count"] for r in per) < 4 * CHUNK_SAMPLES and sum(r["count"] for r in per) == n


def test_nearest_channels_of_a_recording_of_any_size(spark):
    """More channels than one array may hold, on a lattice full of equal distances and shared places."""
    rng = np.random.default_rng(5)
    xyz, names = rng.integers(1, 16, (10050, 3)) / 16, [f"c{i}" for i in rng.permutation(10050)]
    xyz[:300] = xyz[0]
    rows = [("a", n, tuple(map(float, p))) for n, p in zip(names, xyz)] + [("b", "x", (1.0, 0.0, 0.0)), ("b", "y", (2.0, 0.0, 0.0)), ("c", "z", (1.0, 1.0, 1.0))]
    rows += [("b", "none", None), ("b", "zero", (0.0, 0.0, 0.0)), ("b", None, (1.0, 0.0, 0.0)), (None, "x", (1.0, 0.0, 0.0))]
    df = spark.createDataFrame(rows, "recording_id string, channel string, pos struct<x:double,y:double,z:double>")
    got = {}
    for r in ch.nearest_channels(df, 3).collect():
        got.setdefault((r["recording_id"], r["channel"]), {})[r["neighbor_rank"]] = (r["neighbor"], r["distance"])
    assert len(got) == 10052
    assert got["b", "x"] == {1: ("y", 1.0)} and got["b", "y"] == {1: ("x", 1.0)}
    order = np.argsort(names)
    for i in [*range(0, 10050, 25), *range(1, 300, 30)]:
        dist = np.sqrt(((xyz[order] - xyz[i]) ** 2).sum(axis=1))
        near = [int(j) for j in np.argsort(dist, kind="stable")[:4] if order[j] != i][:3]
        assert got["a", names[i]] == {n + 1: (names[order[j]], dist[j]) for n, j in enumerate(near)}
