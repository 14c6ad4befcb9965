"""Archive bookkeeping: subject ids, registry, sidecars, participants, reports."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.channels import natural_key
from ..plans.chunks import CHUNK, SERIES, sample_halo, sequence_index
from .aggregates import run_counters
from .filters import fir_filter
from ..functions import signal as sg

# Processing steps of the processed sidecar, accepted formats.
STEPS = [
    "Bandpass filtering: 0.5-40 Hz", "Notch filtering: 50 Hz", "Re-referencing",
    "ECG artifact removal and detrending", "FASTER bad channel and bad epoch detection",
]
FORMATS = [".bdf", ".edf", ".fif"]


def subject_label(number: Column, width: int = 7) -> Column:
    """Zero-padded subject number; longer numbers keep all digits."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def session_label(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9]", "")


def assign_subject_ids(files: DataFrame, start: int, path: str = "file_path") -> DataFrame:
    """Consecutive subject ids in natural file order."""
    keyed = files.withColumn("_natural", natural_key(F.col(path)))
    at = sequence_index(keyed, [], ["_natural", path], "_pos")
    return at.withColumn("subject_id", subject_label(F.col("_pos") + start)).drop("_pos", "_natural")


def planned_range(files: DataFrame, start: int) -> DataFrame:
    """Planned id range ``(start, start + n - 1)`` of a run."""
    n = F.count(F.lit(1))
    return files.agg(n.alias("file_count"), subject_label(F.lit(start).cast("bigint")).alias("planned_start_subject_id"),
                     subject_label(F.lit(start) + n - 1).alias("planned_end_subject_id"))


def upsert_dataset(registry: DataFrame, runs: DataFrame) -> DataFrame:
    """Merge runs into the registry by ``name``: descriptive fields come from the run, hours accumulate.

    ``runs`` has the registry columns plus ``added_hours``.
    """
    fields = [c for c in registry.columns if c not in ("name", "total_recording_hours")]
    new = runs.select("name", *[F.col(c).alias(f"_n_{c}") for c in fields], F.col("added_hours"), F.lit(True).alias("_hit"))
    merged = registry.join(new, "name", "full_outer")
    hours = F.coalesce("total_recording_hours", F.lit(0.0)) + F.coalesce("added_hours", F.lit(0.0))
    return merged.select(
        "name", *[F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in fields],
        hours.alias("total_recording_hours"),
    )


def sidecar(recordings: DataFrame, channels: DataFrame, task: str, power_line: float = 50.0) -> DataFrame:
    """Sidecar fields per recording; everything that is not EEG, EOG, ECG or EMG counts as misc, triggers too."""
    count = lambda *t: F.count_if(F.col("ch_type").isin(list(t)))
    four = ("EEG", "EOG", "ECG", "EMG")
    per = channels.groupBy("recording_id").agg(
        *[count(t).alias(f"{t}ChannelCount") for t in four],
        (F.count(F.lit(1)) - count(*four)).alias("MiscChannelCount"), count("TRIG").alias("TriggerChannelCount"))
    return recordings.join(per, "recording_id").select(
        "recording_id", F.lit(task).alias("TaskName"), F.col("fs").cast("double").alias("SamplingFrequency"),
        F.lit(float(power_line)).alias("PowerLineFrequency"), F.lit("n/a").alias("SoftwareFilters"),
        *[c for c in per.columns if c != "recording_id"],
        ((F.col("n_samples") - 1) / F.col("fs")).alias("RecordingDuration"), F.lit("continuous").alias("RecordingType"))


def processed_sidecar(base: DataFrame, description: str, flow: str, stamp: str) -> DataFrame:
    """Sidecar of processed data with the step list; the time stamp is a parameter."""
    return base.select(
        "*", F.lit(f"Processed EEG data - {description}").alias("Description"), F.lit(flow).alias("PipelineName"),
        F.lit(stamp).alias("ProcessingDate"), F.array(*[F.lit(s) for s in STEPS]).alias("ProcessingSteps"))


def sidecar_json(fields: DataFrame) -> DataFrame:
    cols = [c for c in fields.columns if c != "recording_id"]
    return fields.select("recording_id", F.to_json(F.struct(*cols)).alias("json"))


def channels_sheet(channels: DataFrame) -> DataFrame:
    """Rows of the channel sheet: name, type, units, description, status."""
    bio = F.col("ch_type").isin("EEG", "EOG", "ECG", "EMG")
    return channels.select(
        "recording_id", F.col("channel").alias("name"), F.col("ch_type").alias("type"),
        F.when(bio, "microV").otherwise("n/a").alias("units"), F.concat("ch_type", F.lit(" channel")).alias("description"),
        F.lit("good").alias("status"))


def upsert_participants(participants: DataFrame, subjects: DataFrame) -> DataFrame:
    """Add unknown subjects (ids compared as text, a ``sub-`` prefix removed); missing fields become ``n/a``."""
    clean = subjects.withColumn("participant_id", F.regexp_replace("participant_id", "sub-", "")).dropDuplicates(["participant_id"])
    new = clean.join(participants.select("participant_id"), "participant_id", "left_anti")
    have = new.columns
    cols = [
        (F.coalesce(F.col(c).cast("string"), F.lit("n/a")) if c in have else F.lit("n/a")).alias(c)
        for c in ("age", "sex", "handedness", "group")
    ]
    return participants.unionByName(new.select("participant_id", *cols))


def format_filter(files: DataFrame, path: str = "file_path") -> DataFrame:
    """``status`` and ``reason`` by the file extension."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
    ok = ext.isin(FORMATS)
    return files.withColumn("status", F.when(ok, "accepted").otherwise("skipped")).withColumn(
        "reason", F.when(~ok, F.concat(F.lit("Unsupported format "), ext)))


def processing_details(log: DataFrame) -> DataFrame:
    """Report rows: file name, hours and the first 100 characters of the error."""
    return log.select(
        "idx", F.regexp_extract("file_path", r"([^/\\]*)$", 1).alias("file"), "copy_status", "process_status",
        "recording_duration", (F.col("recording_duration") / 3600).alias("recording_hours"),
        F.substring("error", 1, 100).alias("error"))


def processing_report(log: DataFrame, title: str, stamp: str) -> DataFrame:
    """Report text as ordered lines: counters first, then one line per file."""
    c = run_counters(log)
    named = [("Files", "total_files"), ("Copied", "copy_success"), ("Processed", "processed_success"), ("Failed", "processed_failed"),
             ("Hours", "total_recording_hours"), ("Success rate", "success_rate")]
    head = [F.struct(F.lit(-100).alias("o"), F.lit(f"# {title} {stamp}").alias("line"))]
    for i, (label, col) in enumerate(named):
        value = F.format_string("%.2f", F.col(col).cast("double")) if col in ("total_recording_hours", "success_rate") else F.col(col).cast("string")
        head.append(F.struct(F.lit(i - 99).alias("o"), F.concat(F.lit(f"- {label}: "), value).alias("line")))
    top = c.select(F.explode(F.array(*head)).alias("h")).select(F.col("h.o").cast("bigint").alias("idx"), "h.line")
    d = processing_details(log)
    line = F.format_string(
        "%d. %s %.1f s (%.2f h) copy=%s process=%s%s", F.col("idx"), F.col("file"), F.col("recording_duration"), F.col("recording_hours"),
        F.col("copy_status"), F.col("process_status"), F.coalesce(F.concat(F.lit(" error: "), "error"), F.lit("")))
    return top.unionByName(d.select("idx", line.alias("line"))).orderBy("idx")


def dataset_summary(registry: DataFrame, current: str | None = None) -> DataFrame:
    """Per dataset: hours, id range, whether it is the current one, and whether the range width fits the file count."""
    width = F.col("planned_end_subject_id").cast("bigint") - F.col("planned_start_subject_id").cast("bigint") + 1
    return registry.select(
        "name", "file_count", "total_recording_hours", "planned_start_subject_id", "planned_end_subject_id",
        (F.col("name") == F.lit(current if current is not None else "")).alias("is_current"),
        width.alias("range_width"), (width == F.col("file_count")).alias("range_ok"))


def run_per_recording(
    signals: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame] | None = None, fs: float | None = None,
    halo: int = 0, chunk: int = 65536,
) -> DataFrame:
    """Apply a user function to the samples of every recording.

    The function gets one bounded stretch of a recording at a time, all channels, as rows ``recording_id,
    channel, sample_idx, value, own``; ``halo`` neighbouring samples on both sides carry ``own = False`` and
    their results are dropped. Without a function: 0.5-40 Hz band-pass and 50 Hz notch.
    """
    if fn is None:
        taps = [sg.bandpass_taps(fs, 0.5, min(40.0, fs / 2 - 1))] + ([sg.notch_taps(fs, [50.0])] if fs > 102 else [])
        return fir_filter(signals, taps)
    rows = sample_halo(signals, halo, halo, chunk).withColumnRenamed("_own", "own")

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns=[CHUNK]).sort_values(["channel", "sample_idx"]).reset_index(drop=True)
        out = fn(pdf.copy())
        if "own" not in out.columns:
            out = out.merge(pdf[["channel", "sample_idx", "own"]], on=["channel", "sample_idx"])
        return out.loc[out["own"], [*SERIES, "sample_idx", "value"]]

    cols = [*SERIES, "sample_idx", "value"]
    packed = rows.select("recording_id", "channel", "sample_idx", "value", "own", CHUNK)
    return packed.groupBy("recording_id", CHUNK).applyInPandas(call, signals.select(*cols).schema)
