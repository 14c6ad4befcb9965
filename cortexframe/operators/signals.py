"""Sample-level projections, joins and packing of signals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.chunks import CHUNK, CHUNK_SAMPLES, SERIES, sequence_index
from ..plans.joins import lookup_join, spread_join


def crop(signals: DataFrame, tmin: float, tmax: float, fs: float) -> DataFrame:
    """Samples ``[int(tmin * fs), int(tmax * fs))``, re-based to zero."""
    lo, hi = int(tmin * fs), int(tmax * fs)
    return signals.filter((F.col("sample_idx") >= lo) & (F.col("sample_idx") < hi)).withColumn(
        "sample_idx", F.col("sample_idx") - lo
    )


def crop_margins(signals: DataFrame, pre: int, post: int, keys: list[str] = SERIES) -> DataFrame:
    """Drop ``pre`` samples at the start and ``post`` at the end of every series, re-based to zero."""
    sizes = signals.groupBy(*keys).agg((F.max("sample_idx") + 1).alias("_n"))
    kept = spread_join(signals, sizes, keys, "sample_idx").filter(
        (F.col("sample_idx") >= pre) & (F.col("sample_idx") < F.col("_n") - post)
    )
    return kept.withColumn("sample_idx", F.col("sample_idx") - pre).select(*signals.columns)


def zero_samples(ranges: DataFrame, size: int = CHUNK_SAMPLES) -> DataFrame:
    """Zero-valued samples for rows carrying a half-open range ``[_lo, _hi)``.

    Ranges are cut into chunks and spread over the cluster before the samples are generated, so a long
    range is not produced by one task.
    """
    keys = [c for c in ranges.columns if c not in ("_lo", "_hi")]
    cut = ranges.filter("_lo < _hi").withColumn(
        CHUNK, F.explode(F.sequence(F.floor(F.col("_lo") / size), F.floor((F.col("_hi") - 1) / size)))
    ).repartition(*keys, CHUNK)
    lo, hi = F.greatest("_lo", F.col(CHUNK) * size), F.least("_hi", (F.col(CHUNK) + 1) * size)
    return cut.select(*keys, F.explode(F.sequence(lo, hi - 1)).alias("sample_idx"), F.lit(0.0).alias("value"))


def fix_channel_count(signals: DataFrame, n: int) -> DataFrame:
    """First ``n`` channels by ``channel_idx``; recordings with fewer get channels of zeros."""
    shape = signals.groupBy("recording_id").agg(
        (F.max("channel_idx") + 1).alias("_c"), (F.max("sample_idx") + 1).alias("_hi")
    ).filter(F.col("_c") < n)
    missing = shape.select(
        "recording_id", F.explode(F.sequence(F.col("_c"), F.lit(n - 1).cast("bigint"))).alias("channel_idx"),
        F.lit(0).cast("bigint").alias("_lo"), "_hi",
    )
    cols = ["recording_id", "channel_idx", "sample_idx", "value"]
    return signals.filter(F.col("channel_idx") < n).select(*cols).unionByName(zero_samples(missing).select(*cols))


def scale_units(signals: DataFrame, source: str = "source") -> DataFrame:
    """Volts to microvolts unless the source is already a normalised file."""
    keep = F.col(source).startswith("normalization")
    return signals.withColumn("value", F.when(keep, F.col("value")).otherwise(F.col("value") * 1e6))


def apply_gain(signals: DataFrame, gains: DataFrame) -> DataFrame:
    """Divide by the channel gain where it is not 1."""
    out = lookup_join(signals, gains.select(*SERIES, "gain"), SERIES, "left")
    value = F.when(F.col("gain").isNotNull() & (F.col("gain") != 1.0), F.col("value") / F.col("gain")).otherwise(F.col("value"))
    return out.withColumn("value", value).drop("gain")


def is_finite(col):
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) < float("inf"))


def drop_nonfinite(df: DataFrame, value: str = "value") -> DataFrame:
    return df.filter(is_finite(F.col(value)))


def drop_nonfinite_series(df: DataFrame, keys: list[str] = SERIES, value: str = "value") -> DataFrame:
    """Drop every series that holds a NaN, infinity or null anywhere."""
    bad = df.filter(~is_finite(F.col(value))).select(*keys).distinct().withColumn("_bad", F.lit(True))
    return lookup_join(df, bad, keys, "left").filter(F.col("_bad").isNull()).select(*df.columns)


def thin(signals: DataFrame, points: int = 50_000, above: int = 100_000, keys: list[str] = SERIES) -> DataFrame:
    """Every ``n // points``-th sample of series longer than ``above`` (display resolution)."""
    sizes = signals.groupBy(*keys).agg((F.max("sample_idx") + 1).alias("_n"))
    step = F.when(F.col("_n") > above, F.floor(F.col("_n") / points)).otherwise(1)
    return spread_join(signals, sizes, keys, "sample_idx").filter(F.col("sample_idx") % step == 0).select(*signals.columns)


NEIGHBOR_SAMPLES = 4096


def neighbor_blocks(signals: DataFrame, neighbors: DataFrame, size: int = NEIGHBOR_SAMPLES) -> DataFrame:
    """``recording_id, channel, block_idx, k, parts``: a stretch of a channel and of its ``k`` neighbours.

    ``parts`` holds ``(rank, at, v)``, rank 0 being the channel itself; a part that has no sample in the stretch is
    missing. Packed stretches travel once to each channel that they are a neighbour of, so work and shuffle are linear in
    the channels. Channels without neighbours take no part.
    """
    packed = signals.withColumn("block_idx", F.floor(F.col("sample_idx") / size).cast("bigint")).groupBy(
        "recording_id", "channel", "block_idx").agg(F.array_sort(F.collect_list(F.struct("sample_idx", "value"))).alias("_s"))
    own = neighbors.groupBy("recording_id", "channel").agg(F.count(F.lit(1)).cast("int").alias("k"))
    edges = neighbors.select("recording_id", F.col("neighbor").alias("from"), "channel", F.col("neighbor_rank").cast("int").alias("rank"))
    edges = edges.unionByName(own.select("recording_id", F.col("channel").alias("from"), "channel", F.lit(0).alias("rank")))
    targets = edges.join(own, ["recording_id", "channel"]).groupBy("recording_id", F.col("from").alias("channel")).agg(
        F.collect_list(F.struct("channel", "k", "rank")).alias("_to"))
    sent = lookup_join(packed, targets, ["recording_id", "channel"]).select(
        "recording_id", "block_idx", "_s", F.explode("_to").alias("_t"))
    part = F.struct(F.col("_t.rank").alias("rank"), F.col("_s.sample_idx").alias("at"), F.col("_s.value").alias("v"))
    got = sent.groupBy("recording_id", F.col("_t.channel").alias("channel"), "block_idx").agg(
        F.max("_t.k").alias("k"), F.array_sort(F.collect_list(part)).alias("parts"))
    return got.filter(F.col("parts")[0]["rank"] == 0)


def gather_neighbors(signals: DataFrame, neighbors: DataFrame, size: int = NEIGHBOR_SAMPLES) -> DataFrame:
    """Values of the neighbour channels at every sample, ordered by ``neighbor_rank``; null where a neighbour has none."""
    blocks = neighbor_blocks(signals, neighbors, size)
    width = neighbors.agg(F.max("neighbor_rank")).first()[0] or 0
    names = [f"n{i}" for i in range(1, width + 1)]

    @F.pandas_udf(", ".join(["at array<bigint>", "v array<double>", *[f"{n} array<double>" for n in names]]))
    def align(parts: pd.Series) -> pd.DataFrame:
        out = []
        for p in parts:
            at, row = np.asarray(p[0]["at"]), [[]] * (width + 2)  # zipping fills short lists with nulls
            row[0], row[1] = at, p[0]["v"]
            for q in p[1:]:
                there = np.asarray(q["at"])
                if len(there) == len(at) and (there == at).all():
                    row[q["rank"] + 1] = q["v"]
                else:
                    known = dict(zip(there.tolist(), q["v"]))
                    row[q["rank"] + 1] = [known.get(i) for i in at.tolist()]
            out.append(row)
        return pd.DataFrame(out, columns=["at", "v", *names])

    flat = blocks.select("recording_id", "channel", "k", align("parts").alias("a"))
    rows = flat.select("recording_id", "channel", "k", F.explode(F.arrays_zip("a.at", "a.v", *[f"a.{n}" for n in names])).alias("z"))
    near = F.slice(F.array(*[F.col(f"z.{n}") for n in names]), F.lit(1), F.col("k"))
    return rows.select(
        "recording_id", "channel", F.col("z.at").alias("sample_idx"), F.col("z.v").alias("value"), near.alias("neighbor_values")
    ).filter(F.col("value").isNotNull())


def window_around_events(signals: DataFrame, peaks: DataFrame, pre: int, post: int) -> DataFrame:
    """Samples ``[r - pre, r + post)`` around every event that lies fully inside its recording.

    The windows are generated from the event table and met with the samples on ``(recording, sample)``.
    """
    sizes = signals.groupBy("recording_id").agg((F.max("sample_idx") + 1).alias("_n"))
    inside = spread_join(peaks.select("recording_id", "peak_idx"), sizes, ["recording_id"], "peak_idx").filter(
        (F.col("peak_idx") >= pre) & (F.col("peak_idx") + post <= F.col("_n"))
    )
    spread = inside.select(
        "recording_id", "peak_idx",
        F.posexplode(F.sequence(F.col("peak_idx") - pre, F.col("peak_idx") + post - 1)).alias("offset", "sample_idx"),
    ).withColumn("offset", F.col("offset").cast("bigint") - pre)
    return signals.join(spread, ["recording_id", "sample_idx"])


def merge_channels(eeg: DataFrame, other: DataFrame) -> DataFrame:
    """Stack two channel groups of the same recordings and cut both to the shorter one."""
    n = lambda df: df.groupBy("recording_id").agg((F.max("sample_idx") + 1).alias("_n"))
    shortest = n(eeg).unionByName(n(other)).groupBy("recording_id").agg(F.min("_n").alias("_n"))
    both = eeg.unionByName(other)
    return spread_join(both, shortest, ["recording_id"], "sample_idx").filter("sample_idx < _n").select(*both.columns)


def trim_to_shortest(signals: DataFrame) -> DataFrame:
    """Cut all channels of a recording to its shortest channel."""
    per = signals.groupBy(*SERIES).agg((F.max("sample_idx") + 1).alias("_n"))
    shortest = per.groupBy("recording_id").agg(F.min("_n").alias("_n"))
    return spread_join(signals, shortest, ["recording_id"], "sample_idx").filter("sample_idx < _n").select(*signals.columns)


def quantize_int16(signals: DataFrame, mode: str = "minmax", keys: list[str] = SERIES) -> DataFrame:
    """Scale every series to the 16-bit range, clip and truncate.

    ``mode="padded"`` widens the physical range to at least [-100, 100].
    """
    lim = signals.groupBy(*keys).agg(F.min("value").alias("phys_min"), F.max("value").alias("phys_max"))
    if mode == "padded":
        hi, lo = F.greatest("phys_max", F.lit(100.0)), F.least("phys_min", F.lit(-100.0))
        tiny = F.abs(hi - lo) < 1.0
        lim = lim.select(*keys, F.when(tiny, -100.0).otherwise(lo).alias("phys_min"), F.when(tiny, 100.0).otherwise(hi).alias("phys_max"))
    out = spread_join(signals, lim, keys, "sample_idx")
    scaled = F.try_divide(F.col("value") - F.col("phys_min"), F.col("phys_max") - F.col("phys_min")) * 65535.0 - 32768.0
    digital = F.least(F.greatest(scaled, F.lit(-32768.0)), F.lit(32767.0)).cast("smallint")
    return out.withColumn("digital", digital)


def unique_channel_names(channels: DataFrame) -> DataFrame:
    """Suffix repeated channel names of a recording with ``_1``, ``_2``, … in channel order."""
    at = sequence_index(channels, SERIES, ["channel_order"], "_nth")
    name = F.when(F.col("_nth") == 0, F.col("channel")).otherwise(F.concat_ws("_", "channel", F.col("_nth").cast("string")))
    return at.withColumn("stored_name", name).drop("_nth")


def pack_blocks(signals: DataFrame, block_samples: int) -> DataFrame:
    """Storage blocks: fixed-length single-precision arrays per channel."""
    idx = F.floor(F.col("sample_idx") / block_samples).cast("bigint").alias("block_idx")
    return signals.groupBy(*SERIES, idx).agg(
        F.array_sort(F.collect_list(F.struct("sample_idx", F.col("value").cast("float").alias("v")))).alias("_s")
    ).select(*SERIES, "block_idx", F.col("_s")[0]["sample_idx"].alias("start_sample"), F.col("_s")["v"].alias("samples"))
