"""The stimulation experiment as one plan: markers, segments, analysis windows, cleaning, spectra, before/after report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import lookup_join, spread_join
from ..plans.materialize import materialize
from .cleaning import JOINT, clean
from .events import before_after_tasks, debounce_markers, markers_to_segments, parse_markers
from .filters import filter_detrend
from .signals import crop_margins
from .spectra import segment_psd
from .stats import before_after_report

WINDOW = ["recording_id", "condition", "segment_idx"]


def analysis_windows(annotations: DataFrame, totals: DataFrame, before: tuple[float, float], after: tuple[float, float],
                     gap: float = 3.0, tail: float = 10.0) -> DataFrame:
    """``recording_id, condition, segment_idx, tmin, tmax`` from the raw annotations.

    Markers closer than ``gap`` seconds count once, those in the last ``tail`` seconds of ``totals(recording_id, total)``
    not at all; consecutive markers bound a segment, and a segment has a window before and one after stimulation.
    """
    marks = debounce_markers(parse_markers(annotations), totals, gap, tail)
    tasks = before_after_tasks(markers_to_segments(marks), annotations, before, after)
    return tasks.withColumnRenamed("seg_idx", "segment_idx")


def cut_windows(signals: DataFrame, windows: DataFrame, fs: float) -> DataFrame:
    """Samples ``[int(tmin * fs), int(tmax * fs))`` of every window, counted from its start.

    A window names the stretches of one window length that it meets, and samples find it by an equi-join on the stretch, so a
    sample only looks at windows next to it. A sample in several windows goes to each of them.
    """
    at = lambda c: F.greatest((F.col(c) * F.lit(float(fs))).cast("bigint"), F.lit(0))
    spans = materialize(windows.select(*WINDOW, at("tmin").alias("_lo"), at("tmax").alias("_hi")).filter("_lo < _hi"))
    width = spans.agg(F.max(F.col("_hi") - F.col("_lo"))).first()[0] or 1
    pieces = spans.withColumn("_at", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor((F.col("_hi") - 1) / width))))
    met = spread_join(signals.withColumn("_at", F.floor(F.col("sample_idx") / width)), pieces, ["recording_id", "_at"], "sample_idx")
    inside = met.filter((F.col("sample_idx") >= F.col("_lo")) & (F.col("sample_idx") < F.col("_hi")))
    return inside.select(*WINDOW, "channel", (F.col("sample_idx") - F.col("_lo")).alias("sample_idx"), "value")


def clean_windows(cut: DataFrame, channels: DataFrame, names: list[str], positions: dict[str, tuple[float, float, float]],
                  fs: float, filtered: bool = True, **how) -> dict[str, DataFrame]:
    """Clean every window as a recording of its own, with a component model of its own.

    ``channels`` describes the channels of the recordings; with ``filtered`` windows first pass the filters of the channel
    types. ``how`` goes to ``clean``; the joint rules hold unless it says otherwise. Results carry the window's columns;
    component labels are named by ``condition`` and ``segment_idx`` as well.
    """
    whole = F.concat_ws("/", *WINDOW)  # the last two parts hold no slash, so names stay apart
    stored = materialize(cut.select(whole.alias("_name"), *WINDOW, "channel", "sample_idx", "value"))  # windows are cut once
    named = stored.select(F.col("_name").alias("recording_id"), "channel", "sample_idx", "value")
    keys = materialize(stored.select("_name", *WINDOW).distinct())
    own = lookup_join(keys, channels, ["recording_id"]).drop(*WINDOW).withColumnRenamed("_name", "recording_id")
    if filtered:
        named = materialize(filter_detrend(named, own, fs, "stim"))
    labels = how.pop("ica_labels", None)
    if labels is not None and "recording_id" in labels.columns:
        labels = labels.withColumn("recording_id", whole).drop(*WINDOW[1:])
    out = clean(named, own, names, positions, fs, ica_labels=labels, **{"rules": JOINT, **how})
    back = keys.withColumnRenamed("recording_id", "_recording")

    def restored(df: DataFrame) -> DataFrame:
        joined = lookup_join(df.withColumnRenamed("recording_id", "_name"), back, ["_name"]).withColumnRenamed("_recording", "recording_id")
        rest = [c for c in joined.columns if c not in ("_name", *WINDOW)]
        return joined.select(*WINDOW, *rest)

    return {name: restored(df) for name, df in out.items()}


def stimulation_report(
    signals: DataFrame, annotations: DataFrame, fs: float, before: tuple[float, float], after: tuple[float, float],
    nperseg: int, channels: DataFrame | None = None, names: list[str] | None = None,
    positions: dict[str, tuple[float, float, float]] | None = None, gap: float = 3.0, tail: float = 10.0, shift: int = 1,
    margins: tuple[float, float] = (0.0, 0.0), fmax: float = 40.0, report_channels: list[str] | None = None, **how,
) -> dict[str, DataFrame]:
    """From samples and annotations to the before/after comparison.

    Returns the analysis ``windows``, their ``spectra`` and what ``before_after_report`` gives. With ``channels``, windows are
    cleaned first (``clean_windows``; ``how`` goes there), and the result holds the epoch decisions and repaired channels.
    ``margins`` are seconds left out at both ends of a cleaned window.
    """
    totals = signals.groupBy("recording_id").agg((F.max("sample_idx") / F.lit(float(fs))).alias("total"))
    windows = materialize(analysis_windows(annotations, totals, before, after, gap, tail))
    cut = cut_windows(signals, windows, fs)
    out = {}
    if channels is not None:
        out = clean_windows(cut, channels, names, positions, fs, **how)
        cut = out.pop("signals")
    pre, post = (int(m * fs) for m in margins)
    if pre or post:
        cut = crop_margins(cut, pre, post, [*WINDOW, "channel"])
    spectra = materialize(segment_psd(cut, fs, nperseg, fmax))
    return {"windows": windows, "spectra": spectra, **out, **before_after_report(spectra, shift, report_channels)}
