"""Channel tables: typing, modality, positions, selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.channels import channel_type, kind_name, kind_units
from ..plans.chunks import sequence_index
from ..plans.joins import MAX_BROADCAST_BYTES, lookup_join, spread_join
from ..plans.materialize import materialize
from ..plans.size import memory_bytes

TILE = 128  # places whose nearest channels are looked for together


def classify_channels(channels: DataFrame, mode: str = "full") -> DataFrame:
    return channels.withColumn("ch_type", channel_type(F.col("channel"), mode))


def map_kind(channels: DataFrame) -> DataFrame:
    """Type and units from the numeric ``kind`` column."""
    return channels.withColumn("ch_type", kind_name(F.col("kind"))).withColumn("units", kind_units(F.col("kind")))


def assign_modality(channels: DataFrame, modalities: DataFrame) -> DataFrame:
    """Exact, case-sensitive membership; the modality with the lowest ``modality_order`` wins."""
    first = modalities.groupBy("channel").agg(F.min_by("modality", "modality_order").alias("modality"))
    return lookup_join(channels, first, ["channel"])


def require_all_modalities(assigned: DataFrame, wanted: list[str]) -> DataFrame:
    """Channels of recordings that have at least one channel in every wanted modality."""
    have = assigned.filter(F.col("modality").isin(wanted)).groupBy("recording_id").agg(
        F.count_distinct("modality").alias("_n")
    ).filter(F.col("_n") == len(wanted))
    return assigned.join(have.select("recording_id"), "recording_id", "left_semi")


def _default_position(name):
    u = F.upper(name)

    def at(x, y, z):
        return F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z"))

    # Region centres by the letters in the name.
    return (
        F.when(u.contains("F"), at(0.0, 0.08, 0.05))
        .when(u.contains("C"), at(0.0, 0.0, 0.1))
        .when(u.contains("P") | u.contains("O"), at(0.0, -0.08, 0.05))
        .when(u.contains("T"), at(-0.07, 0.0, 0.05))
        .otherwise(at(0.0, 0.0, 0.1))
    )


def resolve_positions(channels: DataFrame, montage: DataFrame, mode: str = "midpoint") -> DataFrame:
    """Electrode position ``pos`` from a montage table ``(channel, x, y, z)``.

    A bipolar EEG name gets the midpoint of its two ends, the known end, or a region default.
    ``mode="first"`` splits only on ``-`` and uses the first end or the vertex default.
    """
    sep = "[-_]" if mode == "midpoint" else "-"
    known = montage.select("channel", F.struct("x", "y", "z").alias("p"))
    parts = F.split("channel", sep)
    bipolar = (F.col("ch_type") == "eeg") & F.col("channel").rlike(sep)
    out = channels.withColumn("_a", parts[0]).withColumn("_b", F.try_element_at(parts, F.lit(2)))
    for key, name in (("channel", "_p"), ("_a", "_pa"), ("_b", "_pb")):
        out = lookup_join(out, known.select(F.col("channel").alias(key), F.col("p").alias(name)), [key], "left")
    mid = F.struct(*[((F.col(f"_pa.{c}") + F.col(f"_pb.{c}")) / 2).alias(c) for c in "xyz"])
    vertex = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.1).alias("z"))
    if mode == "midpoint":
        pair = F.when(F.col("_pa").isNotNull() & F.col("_pb").isNotNull(), mid).otherwise(
            F.coalesce("_pa", "_pb", _default_position(F.col("channel")))
        )
    elif mode == "first":
        pair = F.coalesce(F.col("_pa"), vertex)
    else:
        raise ValueError("mode must be 'midpoint' or 'first'")
    pos = F.when(bipolar, pair).otherwise(F.col("_p"))
    return out.withColumn("pos", pos).select(*channels.columns, "pos")


def pick(df: DataFrame, channels: DataFrame | None = None, types: list[str] | None = None,
         names: list[str] | None = None) -> DataFrame:
    """Keep rows by channel name or, with a typed channel table, by channel type."""
    if names is not None:
        return df.filter(F.col("channel").isin(names))
    keep = channels.filter(F.col("ch_type").isin(types)).select("recording_id", "channel").distinct()
    return lookup_join(df, keep, ["recording_id", "channel"])


def drop_channels(df: DataFrame, bads: DataFrame) -> DataFrame:
    """Rows whose channel is not listed as bad for the recording."""
    listed = bads.select("recording_id", "channel").distinct().withColumn("_bad", F.lit(True))
    return lookup_join(df, listed, ["recording_id", "channel"], "left").filter(F.col("_bad").isNull()).drop("_bad")


def rename_type_by_pattern(channels: DataFrame) -> DataFrame:
    """``EMG`` and ``ECG`` by exact name, EOG by pattern; other types stay."""
    n = F.col("channel")
    return channels.withColumn(
        "ch_type",
        F.when(n == "EMG", "emg").when(n == "ECG", "ecg").when(n.rlike("(?i)^EOG[-_]?[A-Za-z0-9]*$"), "eog")
        .otherwise(F.col("ch_type")),
    )


def first_of_type(channels: DataFrame, include_misc: bool = False) -> DataFrame:
    """First ECG, EMG and EOG channel and the number of non-EEG channels of every recording."""
    firsts = [
        F.min_by(F.when(F.col("ch_type") == t, F.col("channel")),
                 F.when(F.col("ch_type") == t, F.col("channel_order"))).alias(f"{t}_channel")
        for t in ("ecg", "emg", "eog")
    ]
    other = F.col("ch_type") != "eeg"
    if not include_misc:
        other = other & (F.col("ch_type") != "misc")
    return channels.groupBy("recording_id").agg(*firsts, F.count_if(other).alias("n_non_eeg"))


def _turns(cells: list[Column]) -> Column:
    """One number whose bits come from three numbers of 20 bits in turn: numbers near each other are places near each other."""
    def spaced(c: Column) -> Column:
        for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
        return c

    x, y, z = map(spaced, cells)
    return x.bitwiseOR(F.shiftleft(y, 1)).bitwiseOR(F.shiftleft(z, 2))


def _tiles(places: DataFrame) -> DataFrame:
    """``recording_id, tile, place, at, names, lo, hi``: up to ``TILE`` places next to each other as arrays, and their box."""
    ends = places.groupBy("recording_id").agg(*[f(f"pos.{c}").alias(f"_{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    met = lookup_join(places, ends, ["recording_id"])
    share = lambda c: (F.col(f"pos.{c}") - F.col(f"_lo{c}")) / F.greatest(F.col(f"_hi{c}") - F.col(f"_lo{c}"), F.lit(1e-300))
    cells = met.select("recording_id", "pos", "names", *[(F.coalesce(F.nanvl(share(c), F.lit(0.0)), F.lit(0.0)) * (2**20 - 1)).cast("bigint").alias(f"_{c}") for c in "xyz"])
    line = cells.select("recording_id", "pos", "names", _turns([F.col(f"_{c}") for c in "xyz"]).alias("_line"))
    numbered = sequence_index(line, ["recording_id"], ["_line", "pos"], "place")
    tile = F.floor(F.col("place") / TILE).cast("bigint").alias("tile")
    packed = numbered.groupBy("recording_id", tile).agg(
        F.array_sort(F.collect_list(F.struct("place", "pos", "names"))).alias("_p"), F.array(*[F.min(f"pos.{c}") for c in "xyz"]).alias("lo"),
        F.array(*[F.max(f"pos.{c}") for c in "xyz"]).alias("hi"))
    at = F.flatten(F.transform("_p", lambda p: F.array(*[p["pos"][c] for c in "xyz"])))
    return packed.select("recording_id", "tile", F.col("_p.place").alias("place"), at.alias("at"), F.col("_p.names").alias("names"), "lo", "hi")


_FOUND = "array<struct<place:bigint,distance:double,neighbor:string>>"


def _closest(place, at, reach, names, places, most: int):
    """For every place up to ``most`` channels of a tile within its reach, by distance and name, and the distance of the last."""
    order, flat = zip(*sorted(((i, n) for i, own in enumerate(names) for n in own), key=lambda e: e[1]))
    there, here = np.reshape(places, (-1, 3))[list(order)], np.reshape(at, (-1, 3))
    dist = np.sqrt(sum((there[None, :, c] - here[:, None, c]) ** 2 for c in range(3)))
    row, col = np.nonzero(~(dist > np.asarray(reach, float)[:, None]))
    by = np.lexsort((col, dist[row, col], row))
    row, col = row[by], col[by]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    found = [(int(place[r]), float(dist[r, c]), flat[c]) for r, c in zip(row[rank < most], col[rank < most])]
    ends = np.full(len(here), np.inf)
    last = rank == most - 1
    ends[row[last]] = dist[row[last], col[last]]
    return found, ends


def nearest_channels(channels: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` nearest other channels by electrode position within a recording, equal distances in order of names.

    Channels without a usable position take no part. The work is done per place: of channels that share one, only the
    ``k + 1`` first names can be among the nearest of any channel. Places lie in tiles along a curve through the recording.
    A tile bounds the distances of its places by its own channels, and then meets the tiles whose boxes lie within reach.
    """
    norm = F.sqrt(sum(F.col(f"pos.{c}") ** 2 for c in "xyz"))
    ok = F.col("pos").isNotNull() & ~F.isnan(norm) & (norm > 1e-6) & F.col("recording_id").isNotNull() & F.col("channel").isNotNull()
    valid = materialize(channels.filter(ok).select("recording_id", "channel", "pos").dropDuplicates(["recording_id", "channel"]))
    nth = F.row_number().over(Window.partitionBy("recording_id", "pos").orderBy("channel"))
    places = valid.withColumn("_n", nth).filter(F.col("_n") <= k + 1).groupBy("recording_id", "pos").agg(F.collect_list("channel").alias("names"))
    tiles = materialize(_tiles(places))

    @F.pandas_udf(f"found {_FOUND}, reach array<double>")
    def within(frame: pd.DataFrame) -> pd.DataFrame:
        rows = zip(*(frame[c] for c in ("place", "at", "reach", "names", "places")))
        return pd.DataFrame([_closest(*row, k + 1) for row in rows], columns=["found", "reach"])

    none = F.transform("place", lambda p: F.lit(float("inf")))
    own = tiles.withColumn("_f", within(F.struct("place", "at", none.alias("reach"), "names", F.col("at").alias("places"))))
    own = materialize(own.select("recording_id", "tile", "lo", "hi", "_f.*"))

    mine = own.select("recording_id", "tile", "lo", "hi", "reach")
    other = own.select("recording_id", F.col("tile").alias("_tile"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    apart = [F.greatest(F.col("_lo")[c] - F.col("hi")[c], F.col("lo")[c] - F.col("_hi")[c], F.lit(0.0)) for c in range(3)]
    gap = F.sqrt(sum(d * d for d in apart)) * (1 - 1e-9)  # rounding must not part a tile from one that it needs
    near = F.isnan(gap) | (gap <= F.array_max("reach"))  # NaN is the largest reach
    pairs = spread_join(mine, other, ["recording_id"], "tile").filter((F.col("tile") != F.col("_tile")) & near)
    side = F.broadcast(tiles) if memory_bytes(tiles) <= MAX_BROADCAST_BYTES else tiles
    met = pairs.select("recording_id", "tile", "_tile", "reach").join(side.select("recording_id", "tile", "place", "at"), ["recording_id", "tile"])
    met = met.join(side.select("recording_id", F.col("tile").alias("_tile"), "names", F.col("at").alias("places")), ["recording_id", "_tile"])
    across = met.select("recording_id", within(F.struct("place", "at", "reach", "names", "places"))["found"].alias("found"))
    found = own.select("recording_id", "found").unionByName(across).select("recording_id", F.inline("found"))
    best = found.groupBy("recording_id", "place").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbor"))), 1, k + 1).alias("_near"))
    spot = F.transform(F.arrays_zip("place", F.sequence(F.lit(0), F.size("place") - 1)), lambda p: F.struct(
        p["place"].alias("place"), F.struct(*[F.get("at", p["1"].cast("int") * 3 + i).alias(c) for i, c in enumerate("xyz")]).alias("pos")))
    spots = tiles.select("recording_id", F.inline(spot)).join(best, ["recording_id", "place"]).drop("place")
    others = F.slice(F.filter("_near", lambda n: n["neighbor"] != F.col("channel")), 1, k)
    out = spread_join(valid, spots, ["recording_id", "pos"], "channel").select("recording_id", "channel", F.posexplode(others).alias("_r", "_n"))
    return out.select(
        "recording_id", "channel", (F.col("_r") + 1).cast("bigint").alias("neighbor_rank"), "_n.neighbor", "_n.distance"
    )
