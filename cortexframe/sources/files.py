"""Readers for file listings, manifests, sheets and text headers."""

from __future__ import annotations

import os
import re
from urllib.parse import quote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.channels import natural_key
from ..plans.chunks import sequence_index

RECORDING_FORMATS = ("bdf", "edf", "fif")


def discover_recordings(spark: SparkSession, path: str, formats: tuple[str, ...] = RECORDING_FORMATS, recursive: bool = True) -> DataFrame:
    """Files below ``path`` by extension (any case) with a natural-order position; contents are not read."""
    glob = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" for c in f) for f in formats) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(path)
    listed = files.select(F.col("path").alias("file_path"), "length", F.col("modificationTime").alias("modified"))
    at = sequence_index(listed.withColumn("natural", natural_key(F.col("file_path"))), [], ["natural", "file_path"], "position")
    return at.drop("natural")


def list_sessions(files: DataFrame, root: str) -> DataFrame:
    """Sub-folder of ``root`` as session, its natural rank as subject offset."""
    session = F.regexp_extract("file_path", root.rstrip("/").replace("\\", "/") + "/([^/]+)/", 1)
    tagged = files.withColumn("session", session).filter("session <> ''")
    names = tagged.select("session").distinct().withColumn("_k", natural_key(F.col("session")))
    ranked = sequence_index(names, [], ["_k", "session"], "subject_offset").drop("_k")
    return tagged.groupBy("session").agg(F.count(F.lit(1)).alias("n_files")).join(ranked, "session")


def read_wfdb_headers(spark: SparkSession, path: str, pattern: str = "*.hea") -> DataFrame:
    """One row per channel of every text header: name is the ninth token, gain the number before ``/`` in the third.

    Short lines become ``EEG<i>`` with gain 1; missing lines are padded up to the channel count.
    """
    raw = spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    head = F.split(F.get(lines, F.lit(0)), r"\s+")
    base = raw.select(
        lines.alias("_l"), F.get(head, F.lit(0)).alias("recording_id"), F.get(head, F.lit(1)).cast("int").alias("n_channels"),
        F.get(head, F.lit(2)).cast("double").alias("fs"), F.get(head, F.lit(3)).cast("bigint").alias("n_samples"))
    at = base.select("*", F.explode(F.sequence(F.lit(1), F.col("n_channels"))).alias("_i"))
    tok = F.split(F.get("_l", F.col("_i")), r"\s+")
    full = F.coalesce(F.size(tok) >= 9, F.lit(False))
    gain = F.coalesce(F.split(F.get(tok, F.lit(2)), "/")[0].try_cast("double"), F.lit(1.0))
    return at.select(
        "recording_id", "fs", "n_samples", (F.col("_i") - 1).cast("bigint").alias("channel_order"),
        F.when(full, F.get(tok, F.lit(8))).otherwise(F.concat(F.lit("EEG"), F.col("_i").cast("string"))).alias("channel"),
        F.when(full, gain).otherwise(1.0).alias("gain"))


def below(path: str, ending: str) -> str:
    """Pattern that captures, of a file below ``path``, the relative path without its ending."""
    base = urlparse(path).path.rstrip("/")
    base = os.path.dirname(base) if base.lower().endswith(ending) else base
    return re.escape(quote(base)) + "/+(.+)" + re.escape(ending) + "$"


def read_hypnograms(spark: SparkSession, path: str, recursive: bool = True, name: str | None = None) -> DataFrame:
    """Stage per epoch from CSV files with a ``sleep_stage`` column, one file per recording.

    The row number is the epoch; the recording is the path below ``path`` without the ending, so files of one name in
    two folders stay apart, or what ``name`` captures from the path.
    """
    name = name or below(path, ".csv")
    raw = spark.read.option("header", True).option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.csv").csv(path)
    rows = raw.select(
        F.regexp_extract(F.col("_metadata.file_path"), name, 1).alias("recording_id"),
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_row"), F.col("sleep_stage").cast("bigint").alias("sleep_stage"))
    return sequence_index(rows, ["_file"], ["_at", "_row"], "epoch_idx").select("recording_id", "epoch_idx", "sleep_stage")


def _json_map(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True)
    entries = raw.select(F.from_json("value", "map<string, array<string>>").alias("m"))
    return entries.select(F.explode(F.map_entries("m")).alias("e")).select(
        F.col("e.key").alias("key"), F.posexplode("e.value").alias("pos", "item"))


def read_split_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``split, position, file`` from a JSON object of file lists."""
    m = _json_map(spark, path)
    return m.select(F.col("key").alias("split"), F.col("pos").cast("bigint").alias("position"), F.col("item").alias("file"))


def read_modality_map(spark: SparkSession, path: str, order: list[str] | None = None) -> DataFrame:
    """``modality, channel, modality_order`` without repeats; the order is that of the file or the given list."""
    raw = spark.read.text(path, wholetext=True)
    keys = raw.select(F.posexplode(F.json_object_keys("value")).alias("_o", "modality"))
    if order is not None:
        keys = keys.filter(F.col("modality").isin(order)).withColumn("_o", F.array_position(F.array(*[F.lit(o) for o in order]), F.col("modality")))
    m = _json_map(spark, path).select(F.col("key").alias("modality"), F.col("item").alias("channel")).dropDuplicates()
    return m.join(keys.select("modality", F.col("_o").cast("bigint").alias("modality_order")), "modality")


EXPERIMENT_SCHEMA = (
    "bdf_folder string, output_base_dir string, subject_name string, sampling_rate double, before_tmin_offset double, "
    "before_tmax_offset double, after_tmin_offset double, after_tmax_offset double, psd_shift_n int"
)
_REQUIRED = ["sampling_rate", "before_tmin_offset", "before_tmax_offset", "after_tmin_offset", "after_tmax_offset"]


def check_experiments(rows: DataFrame, psd_shift_n: int = 1, nperseg_factor: int = 5) -> tuple[DataFrame, DataFrame]:
    """Valid experiments with defaults filled in, and rejected rows with the reason."""
    no_rate = F.col("sampling_rate").isNull() | F.isnan("sampling_rate")
    no_offset = F.lit(False)
    for c in _REQUIRED[1:]:
        no_offset = no_offset | F.col(c).isNull() | F.isnan(c)
    dur = F.col("before_tmax_offset") - F.col("before_tmin_offset")
    reason = F.when(no_rate, "missing sampling_rate").when(no_offset, "missing offset").when(dur <= 0, "duration not positive")
    tagged = rows.withColumn("reason", reason)
    rate = F.col("sampling_rate").cast("int")
    folder = F.regexp_extract("bdf_folder", r"([^/\\]*)$", 1)
    good = tagged.filter("reason IS NULL").drop("reason").withColumn("sampling_rate", rate).withColumn(
        "subject_name", F.coalesce("subject_name", F.concat(F.lit("sub_"), F.substring(folder, 1, 8)))).withColumn(
        "psd_shift_n", F.coalesce("psd_shift_n", F.lit(psd_shift_n))).withColumn(
        "nperseg", F.least((rate * dur).cast("int"), rate * nperseg_factor))
    return good, tagged.filter("reason IS NOT NULL")


def read_experiments(spark: SparkSession, path: str, **defaults) -> tuple[DataFrame, DataFrame]:
    """Experiment sheet exported as CSV; see ``check_experiments``."""
    return check_experiments(spark.read.schema(EXPERIMENT_SCHEMA).option("header", True).csv(path), **defaults)


REGISTRY_FIELDS = (
    "name string, file_count bigint, planned_start_subject_id string, planned_end_subject_id string, "
    "creation_time string, task string, session string, total_recording_hours double"
)


def read_dataset_registry(spark: SparkSession, path: str) -> DataFrame:
    """One row per dataset of a registry JSON file."""
    raw = spark.read.schema(f"DatasetInfo array<struct<{REGISTRY_FIELDS.replace(' ', ':').replace(',:', ', ')}>>").option("multiLine", True).json(path)
    return raw.select(F.inline("DatasetInfo"))
