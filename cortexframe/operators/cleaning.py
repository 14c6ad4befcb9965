"""The cleaning flow: bad channels aside, components, epochs, merge, interpolate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.blocks import to_frames
from ..plans.chunks import SERIES
from ..plans.joins import lookup_join
from ..plans.materialize import materialize
from . import artifacts as art
from .channels import drop_channels
from .events import annotate_bad_epochs, mask_samples
from .ica import IcaModel, ica_apply, select_components
from .keyed_ica import ica_apply_keyed, ica_fit_keyed


@dataclass(frozen=True)
class Rules:
    """Thresholds of a cleaning flow and what it does with epochs.

    ``joint``: a bad epoch with too many bad channels of its own is repaired when these and the recording's together exceed
    30 % of its channels; nothing is marked, and only the share of bad epochs makes a channel bad for the whole recording.
    ``method`` and ``variance`` are those of the component models, ``picked`` the rule of ``select_components``: ``artifact``,
    or ``non_brain`` when stimulation intervals are given, unless stated.
    """

    epoch_z: float = 5.0
    channel_z: float = 3.0
    min_corr: float = 0.8
    joint: bool = False
    method: str = "fastica"
    variance: float | None = 0.99
    picked: str | None = None


STANDARD = Rules()
STIMULATION = Rules(epoch_z=3.0)
JOINT = Rules(epoch_z=2.0, channel_z=2.0, min_corr=0.5, joint=True, method="infomax", variance=None, picked="non_brain_60")


def frames_to_signals(frames: DataFrame, channels: list[str]) -> DataFrame:
    """One row per sample and channel."""
    names = F.array(*[F.lit(c) for c in channels])
    long = frames.select("recording_id", "sample_idx", F.posexplode("values").alias("_i", "value"))
    return long.select("recording_id", F.get(names, F.col("_i")).alias("channel"), "sample_idx", "value")


def _repair(frames: DataFrame, names: list[str], positions: dict, lists: DataFrame, keys: list[str], epoch: int | None = None,
            aside: DataFrame | None = None) -> DataFrame:
    """Interpolate the channels in ``lists.bads`` (per recording or per epoch) from the channels that are there.

    ``aside`` lists the channels that a recording lacks in ``frames``; they are neither used nor made up.
    """
    if epoch:
        frames = frames.withColumn("epoch_idx", F.floor(F.col("sample_idx") / epoch).cast("bigint"))
    joined = lookup_join(frames, lists.select(*keys, "bads"), keys, "left")
    if aside is not None:
        gone = aside.groupBy("recording_id").agg(F.collect_set("channel").alias("_gone"))
        joined = lookup_join(joined, gone, ["recording_id"], "left")
    fixed = art.interpolate(joined, names, positions, absent=None if aside is None else "_gone")
    return fixed.select("recording_id", "sample_idx", "values")


def _finite(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def _filled(signals: DataFrame, names: list[str], positions: dict, aside: DataFrame) -> DataFrame:
    """Frames over all names; the channels of ``aside`` and what a frame lacks are predicted from the others of the frame.

    ``given`` holds the values as they were, ``whole`` is false where nothing was left to predict from.
    """
    lists = aside.groupBy("recording_id").agg(F.collect_set("channel").alias("_aside"))
    frames = lookup_join(to_frames(signals, names, "null"), lists, ["recording_id"], "left")
    lacking = F.filter(F.array(*[F.lit(c) for c in names]), lambda c, i: ~_finite(F.get("values", i)))
    bads = F.array_union(lacking, F.coalesce("_aside", F.array().cast("array<string>")))
    filled = art.interpolate(frames.withColumn("given", F.col("values")).withColumn("bads", bads), names, positions)
    return filled.select("recording_id", "sample_idx", "values", "given", F.forall("values", _finite).alias("whole"))


def _without(frames: DataFrame, model: IcaModel | DataFrame, picked: DataFrame, n_ch: int) -> DataFrame:
    """Frames without the components in ``picked``, which names them per recording or for all.

    A model has at most ``n_ch`` components; larger numbers name none and are not sent along with the frames.
    """
    picked = picked.filter(F.col("component") < n_ch)
    lists = F.array_sort(F.collect_set(F.col("component").cast("int"))).alias("exclude")
    if "recording_id" in picked.columns:
        marked = lookup_join(frames, picked.groupBy("recording_id").agg(lists), ["recording_id"], "left")
    else:  # at most one row per component
        drop = [int(r["component"]) for r in picked.select("component").distinct().collect()]
        marked = frames.withColumn("exclude", F.array(*[F.lit(c) for c in drop]).cast("array<int>"))
    out = ica_apply(marked, model, "exclude") if isinstance(model, IcaModel) else ica_apply_keyed(marked, model, ["recording_id"])
    return out.select(*frames.columns)


def clean(
    signals: DataFrame, channels: DataFrame, names: list[str], positions: dict[str, tuple[float, float, float]], fs: float,
    use_faster: bool = True, remove_bad: bool = False, stim: DataFrame | None = None,
    ica_model: IcaModel | DataFrame | None = None, ica_labels: DataFrame | None = None, use_ica: bool = False,
    epoch_seconds: float = 1.0, max_bad_frac: float | None = None, bads: DataFrame | None = None, rules: Rules | None = None,
) -> dict[str, DataFrame]:
    """Clean the EEG channels ``names`` of every recording; rows of other channels come back unchanged.

    ``stim`` holds stimulation intervals: they are excluded from detection and component fitting and stay
    unchanged. With ``remove_bad``, the bad channels of a recording (detected, or given as ``bads``) are set aside
    while its other channels are cleaned, and interpolated at the end. Components are fitted and applied to frames in
    which the set-aside channels are predictions from the others, so they carry nothing of their own. Every recording has a
    component model of its own, given as the table of ``ica_fit_keyed`` or fitted here; one model for all of them may be
    given instead. Component labels are an input; labels without a ``recording_id`` count for all recordings, and without
    labels nothing is taken out and no model is fitted. Returns the
    cleaned signals, all repaired channels, the epoch decisions and, unless the rules are joint, the bad-epoch annotations.

    ``rules`` are ``STANDARD``, or ``STIMULATION`` when ``stim`` is given, unless stated. ``max_bad_frac`` is 0.5, for joint
    rules 0.2. Joint rules treat all epochs alike; stimulation intervals then only count for detection and components.
    """
    rules = rules or (STANDARD if stim is None else STIMULATION)
    max_bad_frac = max_bad_frac if max_bad_frac is not None else 0.2 if rules.joint else 0.5
    eeg = signals.filter(F.col("channel").isin(names))
    others = signals.filter(~F.col("channel").isin(names))
    calm = eeg if stim is None else mask_samples(eeg, stim, fs)
    none = channels.select(*SERIES).limit(0)
    aside = none
    if remove_bad:
        found = art.detect_bad_channels(calm, channels, fs, rules.min_corr) if bads is None else bads
        aside = materialize(found.select(*SERIES).filter(F.col("channel").isin(names)).distinct())
    good, kept_aside = art.remove_bad(eeg, aside) if remove_bad else (eeg, None)
    if use_ica and ica_labels is not None:
        frames = materialize(_filled(good, names, positions, aside))
        if ica_model is None:
            fit_on = _filled(mask_samples(good, stim, fs), names, positions, aside) if stim is not None else frames
            ica_model = ica_fit_keyed(fit_on.filter("whole"), len(names), ["recording_id"], rules.variance, method=rules.method)
        picked = select_components(ica_labels, rules.picked or ("artifact" if stim is None else "non_brain"))
        left = _without(frames, ica_model, picked, len(names))
        kept = left.withColumn("values", F.zip_with("values", "given", lambda v, g: F.when(F.col("whole") & _finite(g), v).otherwise(g)))
        there = frames_to_signals(kept, names).filter("value IS NOT NULL")
        cleaned = drop_channels(there, aside).unionByName(good.filter("value IS NULL").select(*there.columns))
        if stim is not None:
            cleaned = mask_samples(cleaned, stim, fs).unionByName(mask_samples(good, stim, fs, "inside").select(*cleaned.columns))
        good = materialize(cleaned)
    epochs, often, frames = None, none, None
    if use_faster:
        n = int(epoch_seconds * fs)
        judged_by = None if rules.joint else stim
        table, often = art.epoch_review(good, fs, epoch_seconds, rules.epoch_z, rules.channel_z, judged_by, whole=not rules.joint)
        table, often = materialize(table), materialize(often)
        left = aside.groupBy("recording_id").agg((F.lit(len(names)) - F.count(F.lit(1))).alias("_left"))
        n_left = F.coalesce("_left", F.lit(len(names)))
        if rules.joint:
            epochs = art.epoch_policy_v2(lookup_join(table, left, ["recording_id"], "left"), often, n_left, max_bad_frac).drop("_left")
        elif stim is None:
            epochs = art.epoch_policy(lookup_join(table, left, ["recording_id"], "left"), often, n_left, max_bad_frac).drop("_left")
        else:
            epochs = art.epoch_policy_stim(table)
        done, bad = ("interpolated", "all_bads") if rules.joint else ("repaired", "bad_channels")
        lists = epochs.filter(F.col("action") == done).select("recording_id", "epoch_idx", F.col(bad).alias("bads"))
        frames = _repair(to_frames(good, names, "null"), names, positions, lists, ["recording_id", "epoch_idx"], n, aside if remove_bad else None)
        if remove_bad:
            good = drop_channels(frames_to_signals(frames, names), aside)
    if kept_aside is not None:
        frames = to_frames(good.unionByName(kept_aside.select(*good.columns)), names, "null")
    elif frames is None:
        frames = to_frames(good, names, "null")
    repaired = art.bad_channels(aside, often)
    per = repaired.groupBy("recording_id").agg(F.collect_set("channel").alias("bads"))
    out = frames_to_signals(_repair(frames, names, positions, per, ["recording_id"]), names)
    result = {"signals": out.unionByName(others.select(*out.columns)), "repaired": repaired}
    if epochs is not None:
        result["epochs"] = epochs
        if stim is None and not rules.joint:
            totals = eeg.groupBy("recording_id").agg(((F.max("sample_idx") + 1) / F.lit(float(fs))).alias("total"))
            result["annotations"] = annotate_bad_epochs(epochs.filter("action = 'marked_bad'"), totals, epoch_seconds)
    return result
