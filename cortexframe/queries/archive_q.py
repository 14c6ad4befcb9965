"""Archive, source and sink queries; file formats are written from the test tables and read back."""

from pyspark.sql import functions as F

from ..operators import archive as ar
from ..sources import files as src
from ..sources import tables as tb
from . import fixtures as fx
from .fixtures import scratch
from .registry import query, rounded


@query("arc1_assign_subject_ids", """
SELECT 'file_' || o_orderkey || '.edf' AS file_path, lpad(CAST(100 + row_number() OVER (ORDER BY o_orderkey) - 1 AS VARCHAR), 7, '0') AS subject_id FROM orders""")
def arc1(spark, sf):
    return ar.assign_subject_ids(fx.files(spark, sf).select("file_path"), 100)


@query("arc1_planned_range", """
SELECT count(*) AS file_count, '0000100' AS planned_start_subject_id, lpad(CAST(100 + count(*) - 1 AS VARCHAR), 7, '0') AS planned_end_subject_id FROM orders""")
def arc1b(spark, sf):
    return ar.planned_range(fx.files(spark, sf), 100)


def _runs(spark, sf):
    c = fx.table(spark, sf, "customer").join(fx.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.concat("n_name", F.lit("_new")))
    return c.groupBy(name.alias("name")).agg(
        F.count(F.lit(1)).alias("file_count"), F.min("c_custkey").alias("start_id"), F.max("c_custkey").alias("end_id"), F.sum("c_acctbal").alias("added_hours"))


@query("arc2_upsert_dataset", "WITH " + fx.REGISTRY + """,
runs AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE n_name || '_new' END AS name, count(*) AS file_count, min(c_custkey) AS start_id,
  max(c_custkey) AS end_id, sum(c_acctbal) AS added FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT name, CASE WHEN u.name IS NULL THEN r.file_count ELSE u.file_count END AS file_count, CASE WHEN u.name IS NULL THEN r.start_id ELSE u.start_id END AS start_id,
  CASE WHEN u.name IS NULL THEN r.end_id ELSE u.end_id END AS end_id, round(coalesce(total_recording_hours, 0) + coalesce(added, 0), 3) + 0 AS total_recording_hours
FROM registry r FULL JOIN runs u USING (name)""")
def arc2(spark, sf):
    return rounded(ar.upsert_dataset(fx.registry(spark, sf), _runs(spark, sf)), "total_recording_hours", digits=3)


def _channels(spark, sf):
    kind = F.array(*[F.lit(k) for k in ("EEG", "EOG", "ECG", "EMG", "TRIG", "MISC")])[(F.col("p_size") % 6).cast("int")]
    return fx.table(spark, sf, "part").select(F.col("p_brand").alias("recording_id"), F.col("p_name").alias("channel"), kind.alias("ch_type"), "p_size")


def _fields(spark, sf):
    c = _channels(spark, sf)
    rec = c.groupBy("recording_id").agg(F.lit(128.0).alias("fs"), F.sum("p_size").alias("n_samples"))
    return ar.sidecar(rec, c, "sleep")


_SIDE = """WITH c AS (SELECT p_brand AS recording_id, p_size, ['EEG', 'EOG', 'ECG', 'EMG', 'TRIG', 'MISC'][p_size % 6 + 1] AS t FROM part),
side AS (SELECT recording_id, 'sleep' AS "TaskName", 128.0::DOUBLE AS "SamplingFrequency", 50.0::DOUBLE AS "PowerLineFrequency", 'n/a' AS "SoftwareFilters",
  count(*) FILTER (t = 'EEG') AS "EEGChannelCount", count(*) FILTER (t = 'EOG') AS "EOGChannelCount", count(*) FILTER (t = 'ECG') AS "ECGChannelCount",
  count(*) FILTER (t = 'EMG') AS "EMGChannelCount", count(*) FILTER (t IN ('TRIG', 'MISC')) AS "MiscChannelCount", count(*) FILTER (t = 'TRIG') AS "TriggerChannelCount",
  round((sum(p_size) - 1) / 128.0::DOUBLE, 6) + 0 AS "RecordingDuration", 'continuous' AS "RecordingType" FROM c GROUP BY 1)"""


@query("arc3_sidecar", _SIDE + " SELECT * FROM side")
def arc3(spark, sf):
    return rounded(_fields(spark, sf), "RecordingDuration")


@query("arc3_processed_sidecar", _SIDE + """
SELECT *, 'Processed EEG data - clean' AS "Description", 'main' AS "PipelineName", '2026-01-01' AS "ProcessingDate", 5::BIGINT AS n_steps FROM side""")
def arc3b(spark, sf):
    out = ar.processed_sidecar(rounded(_fields(spark, sf), "RecordingDuration"), "clean", "main", "2026-01-01")
    return out.withColumn("n_steps", F.size("ProcessingSteps").cast("bigint")).drop("ProcessingSteps")


def _participants(spark, sf):
    s = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("participant_id"))
    return s.select("participant_id", *[F.lit("n/a").alias(c) for c in ("age", "sex", "handedness")], F.lit("old").alias("group"))


@query("arc4_upsert_participants", """
SELECT CAST(s_suppkey AS VARCHAR) AS participant_id, 'n/a' AS age, 'n/a' AS sex, 'n/a' AS handedness, 'old' AS "group" FROM supplier
UNION ALL SELECT CAST(c_custkey AS VARCHAR), CASE WHEN c_acctbal < 0 THEN 'n/a' ELSE CAST(c_nationkey AS VARCHAR) END, 'n/a', 'n/a', c_mktsegment FROM customer
WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def arc4(spark, sf):
    c = fx.table(spark, sf, "customer").select(
        F.concat(F.lit("sub-"), F.col("c_custkey").cast("string")).alias("participant_id"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("age"), F.col("c_mktsegment").alias("group"))
    return ar.upsert_participants(_participants(spark, sf), c)


@query("arc5_format_filter", """
SELECT doc_id, CASE WHEN n_chars % 4 < 3 THEN 'accepted' ELSE 'skipped' END AS status, CASE WHEN n_chars % 4 = 3 THEN 'Unsupported format .txt' END AS reason FROM documents""")
def arc5(spark, sf):
    ext = F.array(*[F.lit(e) for e in (".bdf", ".EDF", ".Fif", ".TXT")])[(F.col("n_chars") % 4).cast("int")]
    d = fx.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("a.b/doc_"), F.col("doc_id").cast("string"), ext).alias("file_path"))
    return ar.format_filter(d).select("doc_id", "status", "reason")


@query("arc6_processing_details", "WITH " + fx.FILES + """
SELECT idx, file_path AS file, copy_status, process_status, recording_duration, round(recording_duration / 3600, 6) + 0 AS recording_hours, left(error, 100) AS error FROM files""")
def arc6(spark, sf):
    return rounded(ar.processing_details(fx.files(spark, sf)), "recording_hours")


@query("arc6_processing_report")
def arc6b(spark, sf):
    return ar.processing_report(fx.files(spark, sf), "Report", "2026-01-01")


def _registry(spark, sf):
    r = fx.registry(spark, sf)
    return r.select("name", "file_count", "total_recording_hours", ar.subject_label(F.col("start_id")).alias("planned_start_subject_id"),
                    ar.subject_label(F.col("end_id")).alias("planned_end_subject_id"))


@query("arc7_dataset_summary", "WITH " + fx.REGISTRY + """
SELECT name, file_count, round(total_recording_hours, 3) + 0 AS total_recording_hours, lpad(CAST(start_id AS VARCHAR), 7, '0') AS planned_start_subject_id,
  lpad(CAST(end_id AS VARCHAR), 7, '0') AS planned_end_subject_id, name = 'NATION_3' AS is_current, end_id - start_id + 1 AS range_width, end_id - start_id + 1 = file_count AS range_ok FROM registry""")
def arc7(spark, sf):
    return rounded(ar.dataset_summary(_registry(spark, sf), "NATION_3"), "total_recording_hours", digits=3)


@query("arc8_run_per_recording", "WITH " + fx.SIGNALS + """
SELECT recording_id, channel, sample_idx, round(avg(value) OVER (PARTITION BY recording_id, channel ORDER BY sample_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) + 0 AS value FROM signals""")
def arc8(spark, sf):
    def smooth(pdf):
        pdf["value"] = pdf.groupby("channel")["value"].transform(lambda v: v.rolling(3, center=True, min_periods=1).mean())
        return pdf

    return rounded(ar.run_per_recording(fx.signals(spark, sf), smooth, halo=1, chunk=100), "value")


@query("arc8_run_default")
def arc8b(spark, sf):
    return rounded(ar.run_per_recording(fx.signals(spark, sf), fs=128.0), "value")


def _folders(spark, sf):
    """Supplier rows as one folder per nation with one file each."""
    path = scratch(spark, "listing")
    sup = fx.table(spark, sf, "supplier").join(F.broadcast(fx.table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    sup.select("n_name", "s_suppkey", "s_acctbal").repartition("n_name").write.partitionBy("n_name").parquet(path)
    return path


@query("src1_discover_recordings", """
SELECT 'n_name=' || n_name AS folder, row_number() OVER (ORDER BY n_nationkey) - 1 AS position FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)""")
def src1(spark, sf):
    out = src.discover_recordings(spark, _folders(spark, sf), ("parquet",))
    return out.select(F.regexp_extract("file_path", "([^/]+)/[^/]+$", 1).alias("folder"), "position")


@query("src2_list_sessions", """
SELECT 'n_name=' || n_name AS session, 1::BIGINT AS n_files, row_number() OVER (ORDER BY n_nationkey) - 1 AS subject_offset FROM nation
WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)""")
def src2(spark, sf):
    root = _folders(spark, sf)
    return src.list_sessions(src.discover_recordings(spark, root, ("parquet",)), root)


def _write_bdf(folder):
    """Write one stretch of one channel as a 24-bit file with 0.01 units per step and two seconds per record."""
    import pandas as pd
    from pyarrow import fs as arrow_fs

    def write(pdf):
        x = pdf.sort_values("sample_idx")["value"].to_numpy()
        name = f"{pdf['recording_id'].iloc[0]}_{pdf['channel'].iloc[0]}_{pdf['part'].iloc[0]}"
        records, text = -(-len(x) // 32), lambda v, n: str(v).encode().ljust(n)
        head = b"\xffBIOSEMI" + text("", 160) + b"01.01.2410.00.00" + text(512, 8) + text("", 44) + text(records, 8) + text(2, 8) + text(1, 4)
        for value, n in ((pdf["channel"].iloc[0], 16), ("", 80), ("V", 8), (-10000, 8), (10000, 8), (-1000000, 8), (1000000, 8), ("", 80), (32, 8), ("", 32)):
            head += text(value, n)
        digital = [int(round(v * 100)) for v in x] + [0] * (records * 32 - len(x))
        system, path = arrow_fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (arrow_fs.LocalFileSystem(), folder)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{name}.bdf") as f:
            f.write(head + b"".join(d.to_bytes(3, "little", signed=True) for d in digital))
        return pd.DataFrame({"name": [name]})

    return write


@query("src3_read_edf", "WITH " + fx.SIGNALS + """,
p AS (SELECT recording_id || '_' || channel || '_' || (sample_idx // 4096) AS recording_id, channel, sample_idx % 4096 AS sample_idx, value FROM signals),
n AS (SELECT recording_id, channel, max(sample_idx) + 1 AS n FROM p GROUP BY ALL)
SELECT recording_id, channel, sample_idx, round(value, 6) + 0 AS value FROM p
UNION ALL SELECT recording_id, channel, unnest(range(n, (n + 31) // 32 * 32)) AS sample_idx, 0.0::DOUBLE FROM n""")
def src3(spark, sf):
    from ..plans.blocks import to_samples
    from ..sources import edf

    folder = scratch(spark, "edf")
    parts = fx.signals(spark, sf).withColumn("part", F.floor(F.col("sample_idx") / 4096)).withColumn("sample_idx", F.col("sample_idx") % 4096)
    parts.groupBy("recording_id", "channel", "part").applyInPandas(_write_bdf(folder), "name string").count()
    return rounded(to_samples(edf.read_edf(spark, folder, block_seconds=10.0)), "value")


@query("src4_read_wfdb_headers", """
WITH h AS (SELECT s_nationkey AS k, count(*) + 1 AS nch, sum(s_suppkey) * 1000 AS n FROM supplier GROUP BY 1)
SELECT CAST(s_nationkey AS VARCHAR) AS recording_id, 200.0::DOUBLE AS fs, CAST(n AS BIGINT) AS n_samples, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS channel_order,
  s_name AS channel, CASE WHEN s_suppkey % 2 = 0 THEN 1.0::DOUBLE ELSE CAST(s_suppkey AS DOUBLE) END AS gain FROM supplier JOIN h ON k = s_nationkey
UNION ALL SELECT CAST(k AS VARCHAR), 200.0::DOUBLE, CAST(n AS BIGINT), nch - 1, 'EEG' || nch, 1.0::DOUBLE FROM h""")
def src4(spark, sf):
    path = scratch(spark, "hea")
    k = F.col("s_suppkey").cast("string")
    gain = F.when(F.col("s_suppkey") % 2 == 0, "x").otherwise(k)
    line = F.concat(F.lit("a.mat 16+24 "), gain, F.lit("/uV 16 0 -9 139 0 "), F.col("s_name"))
    per = fx.table(spark, sf, "supplier").groupBy("s_nationkey").agg(
        F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("line"))))["line"].alias("lines"),
        F.count(F.lit(1)).alias("n"), F.sum("s_suppkey").alias("total"))
    head = F.concat_ws(" ", F.col("s_nationkey").cast("string"), (F.col("n") + 1).cast("string"), F.lit("200"), (F.col("total") * 1000).cast("string"))
    text = per.select("s_nationkey", F.concat_ws("\n", head, "lines").alias("value"))  # the last line is missing
    text.repartition("s_nationkey").write.partitionBy("s_nationkey").text(path)
    return src.read_wfdb_headers(spark, path, "*.txt")


@query("src6_read_hypnograms", "WITH " + fx.STAGES + " SELECT recording_id, epoch_idx, sleep_stage FROM stages")
def src6(spark, sf):
    path = scratch(spark, "hyp")
    st = fx.stages(spark, sf).repartition("recording_id").sortWithinPartitions("recording_id", "epoch_idx")
    st.select("recording_id", "sleep_stage").write.partitionBy("recording_id").option("header", True).csv(path)
    return src.read_hypnograms(spark, path, name=r"recording_id=([^/]+)/")


@query("src7_read_split_manifest", """
SELECT 'region_' || n_regionkey AS split, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS position, n_name AS file FROM nation""")
def src7(spark, sf):
    path = scratch(spark, "split")
    n = fx.table(spark, sf, "nation").groupBy(F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")).alias("k")).agg(F.array_sort(F.collect_list("n_name")).alias("v"))
    one = n.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value"))
    one.write.text(path)
    return src.read_split_manifest(spark, path)


@query("src8_read_modality_map", """
SELECT DISTINCT p_brand AS modality, p_type AS channel, dense_rank() OVER (ORDER BY p_brand) - 1 AS modality_order FROM part""")
def src8(spark, sf):
    path = scratch(spark, "modality")
    p = fx.table(spark, sf, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("v"))
    p = p.withColumn("v", F.concat("v", F.slice("v", 1, 1)))  # with a repeated name
    one = p.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p_brand", "v"))))).alias("value"))
    one.write.text(path)
    return src.read_modality_map(spark, path)


def _experiments(spark, sf):
    o = fx.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("/data/run"), k.cast("string"), F.lit("_longname")).alias("bdf_folder"), F.lit("/out").alias("output_base_dir"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("s"), k.cast("string"))).alias("subject_name"),
        F.when(F.col("o_orderstatus") != "P", 250.0).alias("sampling_rate"), F.lit(1.0).alias("before_tmin_offset"),
        (F.col("o_custkey") % 40).cast("double").alias("before_tmax_offset"),
        F.when(~F.col("o_orderpriority").startswith("1"), 0.0).alias("after_tmin_offset"), F.lit(30.0).alias("after_tmax_offset"),
        F.when(F.col("o_orderstatus") == "F", 2).alias("psd_shift_n"))


_EXP = """WITH e AS (SELECT o_orderkey AS k, o_orderstatus AS st, CAST(o_custkey % 40 AS INTEGER) AS b, starts_with(o_orderpriority, '1') AS noff,
  CASE WHEN o_orderstatus = 'P' THEN 'missing sampling_rate' WHEN starts_with(o_orderpriority, '1') THEN 'missing offset' WHEN o_custkey % 40 - 1 <= 0 THEN 'duration not positive' END AS reason FROM orders)"""


@query("src9_experiments_valid", _EXP + """
SELECT '/data/run' || k || '_longname' AS bdf_folder, CASE WHEN st = 'F' THEN 's' || k ELSE 'sub_' || left('run' || k || '_longname', 8) END AS subject_name,
  CAST(least(250 * (b - 1), 1250) AS BIGINT) AS nperseg, CASE WHEN st = 'F' THEN 2::BIGINT ELSE 1::BIGINT END AS psd_shift_n FROM e WHERE reason IS NULL""")
def src9(spark, sf):
    path = scratch(spark, "exp")
    _experiments(spark, sf).write.option("header", True).csv(path)
    good, _ = src.read_experiments(spark, path)
    return good.select("bdf_folder", "subject_name", F.col("nperseg").cast("bigint").alias("nperseg"), F.col("psd_shift_n").cast("bigint").alias("psd_shift_n"))


@query("src9_experiments_rejected", _EXP + " SELECT '/data/run' || k || '_longname' AS bdf_folder, reason FROM e WHERE reason IS NOT NULL")
def src9b(spark, sf):
    return src.check_experiments(_experiments(spark, sf))[1].select("bdf_folder", "reason")


@query("src10_read_dataset_registry", "WITH " + fx.REGISTRY + """
SELECT name, file_count, lpad(CAST(start_id AS VARCHAR), 7, '0') AS planned_start_subject_id, round(total_recording_hours, 3) + 0 AS total_recording_hours FROM registry""")
def src10(spark, sf):
    path = scratch(spark, "registry")
    info = F.array_sort(F.collect_list(F.struct("name", "file_count", "planned_start_subject_id", "planned_end_subject_id", "total_recording_hours")))
    _registry(spark, sf).agg(F.to_json(F.struct(info.alias("DatasetInfo"))).alias("value")).write.text(path)
    out = src.read_dataset_registry(spark, path)
    return rounded(out.select("name", "file_count", "planned_start_subject_id", "total_recording_hours"), "total_recording_hours", digits=3)


@query("snk1_write_archive", "WITH " + fx.SIGNALS + """
SELECT recording_id, channel, sample_idx, value, 'sub-000000' || substr(recording_id, 2) AS subject, 'ses1' AS session, 'sleep' AS task, 'clean' AS "desc" FROM signals""")
def snk1(spark, sf):
    path = scratch(spark, "archive")
    s = fx.signals(spark, sf).withColumn("subject_number", F.substring("recording_id", 2, 9).cast("bigint")).withColumn("session", F.lit("ses-1"))
    tb.write_archive(s, path, "sleep", "clean")
    return spark.read.parquet(path)


@query("snk1_rewrite", "WITH " + fx.SIGNALS + """
SELECT recording_id, channel, count(*) AS n, count(DISTINCT sample_idx) AS n_distinct FROM signals GROUP BY ALL""")
def snk1b(spark, sf):
    path = scratch(spark, "archive")
    s = fx.signals(spark, sf).withColumn("subject_number", F.substring("recording_id", 2, 9).cast("bigint")).withColumn("session", F.lit("ses-1"))
    for _ in range(2):  # the second run replaces what the first one wrote
        tb.write_archive(s, path, "sleep", "clean")
    return spark.read.parquet(path).groupBy("recording_id", "channel").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("sample_idx").alias("n_distinct"))


@query("snk2_write_sidecars", _SIDE + """
SELECT recording_id, "EEGChannelCount" AS eeg, "RecordingType" AS kind FROM side""")
def snk2(spark, sf):
    path = scratch(spark, "sidecar")
    tb.write_sidecars(_fields(spark, sf), path)
    back = spark.read.text(path)
    return back.select("recording_id", F.get_json_object("value", "$.EEGChannelCount").cast("bigint").alias("eeg"),
                       F.get_json_object("value", "$.RecordingType").alias("kind"))


@query("snk2_write_participants", """
SELECT CAST(c_custkey AS VARCHAR) AS participant_id, CASE WHEN c_acctbal < 0 THEN 'n/a' ELSE CAST(c_nationkey AS VARCHAR) END AS age FROM customer""")
def snk2b(spark, sf):
    path = scratch(spark, "people")
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("participant_id"), F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("age"))
    tb.write_sheet(c, path)
    return spark.read.schema("participant_id string, age string").option("header", True).option("sep", "\t").csv(path)


@query("snk5_write_results", "WITH " + fx.PSD + " SELECT recording_id, condition, segment_idx, channel, freq, round(power_db, 6) + 0 AS power_db FROM psd")
def snk5(spark, sf):
    path = scratch(spark, "results")
    tb.write_results(fx.psd(spark, sf), path)
    return rounded(spark.read.parquet(path), "power_db")


@query("snk6_skip_done", "WITH " + fx.FILES + " SELECT file_path, idx FROM files WHERE process_status = 'failed'")
def snk6(spark, sf):
    f = fx.files(spark, sf)
    return tb.skip_done(f.select("file_path", "idx"), f.filter("process_status <> 'failed'"), ["file_path"])
