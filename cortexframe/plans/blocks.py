"""Signal blocks: bounded arrays of consecutive samples, and halo exchange between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import SERIES

BLOCK_SAMPLES = 16384
FEW_CHANNELS = 16  # up to here a frame takes one column per channel while it is gathered


def to_blocks(signals: DataFrame, size: int = BLOCK_SAMPLES, keys: list[str] = SERIES) -> DataFrame:
    """Long samples to ``(keys, block_idx, start_sample, samples)``; a block holds at most ``size`` samples."""
    numbered = signals.withColumn("block_idx", F.floor(F.col("sample_idx") / size).cast("bigint"))
    packed = numbered.groupBy(*keys, "block_idx").agg(
        F.array_sort(F.collect_list(F.struct("sample_idx", "value"))).alias("_s")
    )
    return packed.select(
        *keys, "block_idx", F.col("_s")[0]["sample_idx"].alias("start_sample"), F.col("_s")["value"].alias("samples")
    )


def to_samples(blocks: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Blocks back to one row per sample; no shuffle."""
    long = blocks.select(*keys, "start_sample", F.posexplode("samples").alias("_p", "value"))
    return long.select(*keys, (F.col("start_sample") + F.col("_p")).alias("sample_idx"), "value")


def with_halo(
    blocks: DataFrame, before: int, after: int, size: int = BLOCK_SAMPLES, keys: list[str] = SERIES
) -> DataFrame:
    """Give every block the ``before`` samples to its left and ``after`` to its right.

    Each block sends its own samples to itself and only the overlapping slices to its neighbours, so the one
    shuffle moves whole arrays plus the halo. Adds ``n_left`` / ``n_right`` (halo samples really present,
    fewer at the ends of a recording); ``samples`` becomes halo + block + halo.
    """
    reach_r = -(-before // size)
    reach_l = -(-after // size)
    n = F.size("samples")
    pieces = [F.struct(F.lit(0).alias("d"), F.col("samples").alias("part"))]
    for d in range(1, reach_r + 1):
        want = before - (d - 1) * size
        take = F.least(n, F.lit(min(want, size)))
        pieces.append(F.struct(F.lit(d).alias("d"), F.slice("samples", n - take + 1, take).alias("part")))
    for d in range(1, reach_l + 1):
        want = after - (d - 1) * size
        take = F.least(n, F.lit(min(want, size)))
        pieces.append(F.struct(F.lit(-d).alias("d"), F.slice("samples", F.lit(1), take).alias("part")))
    sent = blocks.select(*keys, "block_idx", "start_sample", F.explode(F.array(*pieces)).alias("_p"))
    sent = sent.select(
        *keys, (F.col("block_idx") + F.col("_p.d")).alias("block_idx"), F.col("start_sample"),
        (-F.col("_p.d")).alias("_from"), F.col("_p.part").alias("_part"),
    )
    got = sent.groupBy(*keys, "block_idx").agg(
        F.array_sort(F.collect_list(F.struct("_from", "_part", "start_sample"))).alias("_ps")
    )
    own = F.filter("_ps", lambda p: p["_from"] == 0)
    length = lambda sign: F.aggregate(
        F.filter("_ps", (lambda p: p["_from"] < 0) if sign < 0 else (lambda p: p["_from"] > 0)),
        F.lit(0), lambda acc, p: acc + F.size(p["_part"]),
    )
    return got.filter(F.size(own) > 0).select(
        *keys, "block_idx", own[0]["start_sample"].alias("start_sample"),
        length(-1).alias("n_left"), length(1).alias("n_right"),
        F.flatten(F.transform("_ps", lambda p: p["_part"])).alias("samples"),
    )


def to_frames(signals: DataFrame, channels: list[str], partial: str = "error") -> DataFrame:
    """Long samples to one array over the given channel order per ``(recording, sample)``.

    A sample without one of the channels stops the job (``partial="error"``) or holds null in its place
    (``partial="null"``); no sample is left out. A channel that a sample has twice stops the job.
    """
    order = F.create_map(*[x for i, c in enumerate(channels) for x in (F.lit(c), F.lit(i))])
    put = signals.withColumn("_i", F.try_element_at(order, F.col("channel"))).filter(F.col("_i").isNotNull())
    if partial == "null" and len(channels) <= FEW_CHANNELS:
        at = [F.col("_i") == i for i in range(len(channels))]
        wide = put.groupBy("recording_id", "sample_idx").agg(
            *[F.max(F.when(c, F.col("value"))).alias(f"_v{i}") for i, c in enumerate(at)],
            F.greatest(*[F.count_if(c) for c in at], F.lit(0)).alias("_most"))
        what = F.concat(F.lit("a sample has a channel twice: "), F.col("recording_id"), F.lit(", "), F.col("sample_idx").cast("string"))
        values = F.when(F.col("_most") > 1, F.raise_error(what)).otherwise(F.array(*[f"_v{i}" for i in range(len(channels))]))
        return wide.select("recording_id", "sample_idx", values.alias("values"))
    packed = put.groupBy("recording_id", "sample_idx").agg(
        F.array_sort(F.collect_list(F.struct("_i", "value"))).alias("_v")
    )
    if partial == "null":
        placed = F.map_from_entries("_v")
        whole = F.col("_v")["_i"] == F.array(*[F.lit(i) for i in range(len(channels))])
        values = F.when(whole, F.col("_v")["value"]).otherwise(
            F.transform(F.sequence(F.lit(0), F.lit(len(channels) - 1)), lambda i: F.try_element_at(placed, i)))
    elif partial == "error":
        what = F.concat(F.lit("a sample lacks a channel: "), F.col("recording_id"), F.lit(", "), F.col("sample_idx").cast("string"))
        values = F.when(F.size("_v") == len(channels), F.col("_v")["value"]).otherwise(F.raise_error(what))
    else:
        raise ValueError("partial must be 'error' or 'null'")
    return packed.select("recording_id", "sample_idx", values.alias("values"))
