"""Interval logic as equi-joins on bounded time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import CHUNK, CHUNK_SAMPLES, range_chunks, running
from .joins import MAX_BROADCAST_BYTES
from .materialize import materialize
from .size import memory_bytes


def merge_intervals(
    intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end", parts: int | None = None
) -> DataFrame:
    """Union overlapping or touching intervals (``start <= current end``) within ``keys``.

    Copies and equal starts collapse in a partial aggregation first. The running maximum end and the island
    number are carried across balanced range chunks, so one hot key spreads over many tasks.
    """
    starts = intervals.groupBy(*keys, start).agg(F.max(end).alias(end))
    chunked = range_chunks(starts, keys, [start], parts)
    seen = running(chunked, keys, [start], {"_reach": ("max", F.col(end))}, inclusive=False)
    opens = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), 1).otherwise(0)
    numbered = running(seen.withColumn("_open", opens), keys, [start], {"_island": ("sum", F.col("_open"))})
    merged = numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end))
    return merged.drop("_island")


def explode_buckets(df: DataFrame, lo: Column, hi: Column, width: float, name: str = "_bucket") -> DataFrame:
    """One row per bucket of ``width`` that ``[lo, hi]`` touches."""
    first = F.floor(lo / F.lit(float(width))).cast("bigint")
    last = F.floor(hi / F.lit(float(width))).cast("bigint")
    return df.withColumn(name, F.explode(F.sequence(first, F.greatest(first, last))))


def sample_ranges(intervals: DataFrame, keys: list[str], size: int = CHUNK_SAMPLES) -> DataFrame:
    """Merged half-open sample ranges ``[s, e)`` clipped to chunks: at most ``size / 2`` rows per chunk."""
    merged = merge_intervals(intervals.filter("s < e"), keys, "s", "e")
    cut = merged.withColumn(
        CHUNK, F.explode(F.sequence(F.floor(F.col("s") / size), F.floor((F.col("e") - 1) / size)))
    )
    return cut.select(
        *keys, F.col(CHUNK).cast("bigint").alias(CHUNK),
        F.greatest("s", F.col(CHUNK) * size).alias("s"), F.least("e", (F.col(CHUNK) + 1) * size).alias("e"),
    )


def covered(
    samples: DataFrame, intervals: DataFrame, keys: list[str], how: str = "left_anti",
    index: str = "sample_idx", size: int = CHUNK_SAMPLES,
) -> DataFrame:
    """Keep samples outside (``left_anti``) or inside (``left_semi``) the sample ranges ``[s, e)``.

    ``how="flag"`` keeps all samples and adds a boolean ``inside``.

    Both sides meet on ``(keys, chunk)``; ranges are merged before, so a sample meets at most one of them and
    a chunk is bounded. The merged ranges are stored, so their size is known: few are broadcast, many meet by shuffle.
    """
    stored = materialize(sample_ranges(intervals, keys, size))
    if memory_bytes(stored) <= MAX_BROADCAST_BYTES:  # usual: few intervals, the samples stay where they are
        stored = F.broadcast(stored)
    ranges = stored.alias("r")
    left = samples.withColumn(CHUNK, F.floor(F.col(index) / size).cast("bigint")).alias("l")
    cond = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, CHUNK]]
    cond += [F.col(f"l.{index}") >= F.col("r.s"), F.col(f"l.{index}") < F.col("r.e")]
    if how == "flag":
        joined = left.join(ranges, cond, "left")
        return joined.select(*[F.col(f"l.{c}") for c in samples.columns], F.col("r.s").isNotNull().alias("inside"))
    return left.join(ranges, cond, how).drop(CHUNK)
