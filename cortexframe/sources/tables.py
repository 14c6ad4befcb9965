"""Native tables and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.archive import channels_sheet, session_label, sidecar_json, subject_label

SIGNALS = "recording_id string, channel string, sample_idx bigint, value double"
ANNOTATIONS = "recording_id string, onset double, duration double, description string"


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SIGNALS).parquet(path)


def read_annotations(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    reader = spark.read.schema(ANNOTATIONS)
    return reader.parquet(path) if format == "parquet" else reader.option("header", True).csv(path)


def archive_layout(rows: DataFrame, task: str, desc: str, width: int = 7) -> DataFrame:
    """Partition columns of the archive from ``subject_number`` and ``session``."""
    return rows.withColumn("subject", F.concat(F.lit("sub-"), subject_label(F.col("subject_number"), width))).withColumn(
        "session", session_label(F.col("session"))).withColumn("task", F.lit(task)).withColumn("desc", F.lit(desc)).drop("subject_number")


def _replace(writer, *partitions: str):
    """Overwrite only the partitions that the rows belong to, so writing the same rows again changes nothing."""
    return writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions)


def write_archive(rows: DataFrame, root: str, task: str, desc: str, width: int = 7) -> None:
    """Write under ``subject / session / task / desc``; what a folder held before is replaced.

    Rows are spread by hash inside a subject, so one large subject is written by many tasks.
    """
    laid = archive_layout(rows, task, desc, width)
    spread = F.pmod(F.floor(F.col("sample_idx") / 65536), F.lit(64)) if "sample_idx" in rows.columns else F.lit(0)
    _replace(laid.repartition("subject", "session", spread).write, "subject", "session", "task", "desc").parquet(root)


def write_sidecars(fields: DataFrame, path: str) -> None:
    """One JSON line per recording, in a folder per recording that replaces an earlier one."""
    _replace(sidecar_json(fields).select("recording_id", F.col("json").alias("value")).write, "recording_id").text(path)


def write_sheet(rows: DataFrame, path: str) -> None:
    """Tab-separated sheet with a header and ``n/a`` for missing values."""
    rows.write.mode("overwrite").option("header", True).option("sep", "\t").option("nullValue", "n/a").option("emptyValue", "").csv(path)


def write_channels_sheet(channels: DataFrame, path: str) -> None:
    _replace(channels_sheet(channels).write, "recording_id").option("header", True).option(
        "sep", "\t").option("nullValue", "n/a").csv(path)


def write_processing_log(lines: DataFrame, path: str) -> None:
    """Report lines as text; ``lines`` comes ordered from the report."""
    lines.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def write_blocks(blocks: DataFrame, path: str, codec: str = "zstd") -> None:
    """Storage blocks, sorted inside files so that a channel's stretch is one row-group range.

    A recording has a folder of its own, which a later write of the recording replaces.
    """
    spread = F.pmod(F.col("block_idx"), F.lit(64))
    laid = blocks.repartition("recording_id", spread).sortWithinPartitions("recording_id", "channel", "block_idx")
    _replace(laid.write, "recording_id").option("compression", codec).parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_blocks`` stored; recording ids are read as text."""
    stored = spark.read.parquet(path)
    kinds = ", ".join(f"`{f.name}` {'string' if f.name == 'recording_id' else f.dataType.simpleString()}" for f in stored.schema)
    return spark.read.schema(kinds).parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def skip_done(tasks: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks whose keys are not in the manifest of finished work."""
    return tasks.join(manifest.select(*keys).distinct(), keys, "left_anti")
