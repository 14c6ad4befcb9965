"""Annotations: markers, stimulation intervals, segments and blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.chunks import CHUNK, range_chunks, running, sequence_index
from ..plans.intervals import covered, explode_buckets, merge_intervals
from ..plans.joins import lookup_join, spread_join
from ..plans.materialize import drop_table, materialize


def is_marker(description: Column) -> Column:
    text = F.trim(description)
    return (
        text.rlike(r"2001\b\D*(\d+)") | (text == "2001") | text.rlike(r"5000\b\D*(\d+)") | text.rlike(r"2001\s+\d+")
    )


def parse_markers(annotations: DataFrame) -> DataFrame:
    """Annotations that open a segment, with their trimmed text as ``sequence``."""
    return annotations.filter(is_marker(F.col("description"))).withColumn("sequence", F.trim("description"))


def file_prefix(path: Column) -> Column:
    """File name without folder, extension and a trailing ``_<digits>``."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")
    return F.regexp_replace(stem, r"_\d+$", "")


def pair_stim(
    annotations: DataFrame, order: str, start_prefix: str = "Start of stimulation",
    end_prefix: str = "End of stimulation", strict_compat: bool = False,
) -> DataFrame:
    """Start/end times per ``[a, b]`` identifier; the last one by ``order`` wins; only start < end is kept.

    ``strict_compat`` also drops pairs with a zero time.
    """
    d = F.col("description")
    ident = r"\[(\d+),\s*(\d+)\]"
    is_start, is_end = d.startswith(start_prefix), d.startswith(end_prefix) & ~d.startswith(start_prefix)
    tagged = annotations.filter((is_start | is_end) & d.rlike(ident)).select(
        "recording_id", F.regexp_extract(d, ident, 1).cast("bigint").alias("id_a"),
        F.regexp_extract(d, ident, 2).cast("bigint").alias("id_b"), F.col(order).alias("_o"),
        F.when(is_start, F.col("onset")).alias("_s"), F.when(~is_start, F.col("onset") + F.col("duration")).alias("_e"),
    )
    pairs = tagged.groupBy("recording_id", "id_a", "id_b").agg(
        F.max_by("_s", F.when(F.col("_s").isNotNull(), F.col("_o"))).alias("start"),
        F.max_by("_e", F.when(F.col("_e").isNotNull(), F.col("_o"))).alias("end"),
    ).filter(F.col("start") < F.col("end"))
    return pairs.filter((F.col("start") != 0) & (F.col("end") != 0)) if strict_compat else pairs


def pad_intervals(intervals: DataFrame, mode: str = "fixed") -> DataFrame:
    """Widen by 2 s on both sides; ``mode="short_long"`` adds 30 s after intervals shorter than 28 s."""
    after = F.lit(2.0)
    if mode == "short_long":
        after = F.when(F.col("end") - F.col("start") < 28, 30.0).otherwise(2.0)
    return intervals.withColumn("end", F.col("end") + after).withColumn(
        "start", F.greatest(F.lit(0.0), F.col("start") - 2)
    )


def merge_and_pad(intervals: DataFrame, pad: float = 2.0, keys: list[str] = ["recording_id"]) -> DataFrame:
    """Merge overlapping or touching intervals, then widen the result without merging again."""
    merged = merge_intervals(intervals, keys)
    return merged.withColumn("start", F.greatest(F.lit(0.0), F.col("start") - pad)).withColumn("end", F.col("end") + pad)


def _sample_ranges(intervals: DataFrame, fs: float) -> DataFrame:
    at = lambda c: F.greatest((F.col(c) * fs).cast("bigint"), F.lit(0))
    return intervals.select("recording_id", at("start").alias("s"), at("end").alias("e"))


def mask_samples(signals: DataFrame, intervals: DataFrame, fs: float, keep: str = "outside") -> DataFrame:
    """Samples outside (or inside) the intervals, each covering ``[int(start * fs), int(end * fs))``."""
    how = "left_anti" if keep == "outside" else "left_semi"
    return covered(signals, _sample_ranges(intervals, fs), ["recording_id"], how)


def flag_epochs(epochs: DataFrame, intervals: DataFrame, length: float, fs: float) -> DataFrame:
    """Boolean ``is_stim``: the epoch ``[i T, i T + T - 1/fs]`` overlaps an interval.

    Every interval becomes the exact range of epoch numbers it touches, so the overlap test is an
    equi-join on epoch chunks.
    """
    t, tail = float(length), float(length) - 1.0 / fs

    def first(cond, guess):
        out = guess + 2
        for d in (1, 0, -1):
            out = F.when(cond(guess + d), guess + d).otherwise(out)
        return out

    lo = first(lambda i: i * t + tail > F.col("start"), F.floor((F.col("start") - tail) / t))
    hi = first(lambda i: i * t >= F.col("end"), F.floor(F.col("end") / t))
    ranges = intervals.select(
        "recording_id", F.greatest(lo, F.lit(0)).cast("bigint").alias("s"), hi.cast("bigint").alias("e")
    )
    return covered(epochs, ranges, ["recording_id"], "flag", "epoch_idx").withColumnRenamed("inside", "is_stim")


def annotations_in_segment(annotations: DataFrame, segments: DataFrame, width: float = 600.0) -> DataFrame:
    """Annotations with ``seg_start <= onset <= seg_end``; one on a shared border belongs to both segments."""
    s = explode_buckets(segments, F.col("seg_start"), F.col("seg_end"), width)
    a = annotations.withColumn("_bucket", F.floor(F.col("onset") / width).cast("bigint"))
    hit = (F.col("onset") >= F.col("seg_start")) & (F.col("onset") <= F.col("seg_end"))
    return spread_join(a, s, ["recording_id", "_bucket"], "onset").filter(hit).drop("_bucket")


def debounce_markers(markers: DataFrame, total: DataFrame, gap: float = 3.0, tail: float = 10.0) -> DataFrame:
    """Keep the first marker; keep a later one only if it comes more than ``gap`` s after the last kept one and
    more than ``tail`` s before the recording ends.

    Equal onsets collapse to their first marker beforehand.
    """
    once = markers.groupBy("recording_id", "onset").agg(F.min_by("sequence", "event_id").alias("sequence"))
    firsts = once.groupBy("recording_id").agg(F.min("onset").alias("_first"))
    allowed = spread_join(once, firsts.join(total, "recording_id"), ["recording_id"], "onset").filter(
        (F.col("onset") == F.col("_first")) | (F.col("total") - F.col("onset") > tail)
    ).select("recording_id", "onset", "sequence")
    kept = keep_spaced(allowed, ["recording_id"], "onset", gap)
    return allowed.join(kept, ["recording_id", "onset"])


def markers_to_segments(markers: DataFrame) -> DataFrame:
    """Stretch between consecutive markers; the last marker opens none."""
    at = sequence_index(markers.select("recording_id", "onset", "sequence"), ["recording_id"], ["onset"], "seg_idx")
    nxt = at.select(
        "recording_id", (F.col("seg_idx") - 1).alias("seg_idx"), F.col("onset").alias("seg_end"),
        F.col("sequence").alias("end_seq"),
    )
    return at.join(nxt, ["recording_id", "seg_idx"]).select(
        "recording_id", "seg_idx", F.col("onset").alias("seg_start"), "seg_end", F.col("sequence").alias("start_seq"), "end_seq"
    )


def before_after_tasks(
    segments: DataFrame, annotations: DataFrame, before: tuple[float, float], after: tuple[float, float],
    width: float = 600.0,
) -> DataFrame:
    """Analysis windows per segment.

    ``before`` needs a stimulation start inside the segment and counts from the segment start; ``after``
    counts from the last stimulation end (or any text with 2000) inside it. Texts look for segments in stretches of at most
    ``width`` seconds, or of the mean segment where that is shorter, so the pairs they form do not outnumber the rows by far.
    """
    segments = materialize(segments)
    mean = segments.agg(F.avg(F.col("seg_end") - F.col("seg_start"))).first()[0]
    hits = annotations_in_segment(annotations, segments, min(width, mean) if mean and mean > 0 else width)
    d = F.col("description")
    ends = d.contains("End of stimulation") | d.contains("2000")
    marks = hits.groupBy("recording_id", "seg_idx", "seg_start").agg(
        F.min(F.when(d.contains("Start of stimulation"), F.col("onset"))).alias("_start"),
        F.max(F.when(ends, F.col("onset"))).alias("_end"),
    )
    rows = F.array(
        F.struct(F.lit("before").alias("condition"), F.when(F.col("_start").isNotNull(), F.col("seg_start")).alias("t"),
                 F.lit(float(before[0])).alias("lo"), F.lit(float(before[1])).alias("hi")),
        F.struct(F.lit("after").alias("condition"), F.col("_end").alias("t"),
                 F.lit(float(after[0])).alias("lo"), F.lit(float(after[1])).alias("hi")),
    )
    out = marks.select("recording_id", "seg_idx", F.explode(rows).alias("r")).filter("r.t IS NOT NULL")
    return out.select(
        "recording_id", "seg_idx", "r.condition", (F.col("r.t") + F.col("r.lo")).alias("tmin"),
        (F.col("r.t") + F.col("r.hi")).alias("tmax"),
    )


def six_block_design(annotations: DataFrame, offset: float = 60.0, length: float = 240.0, sham_below: float = 120.0) -> DataFrame:
    """Three baseline and three stimulation-off blocks per recording, in whole seconds.

    Counting starts at the first text with 5000. A first stimulation shorter than ``sham_below`` makes the
    recording a sham one. Recordings with unequal start and end counts or missing markers give no blocks.
    """
    d = F.col("description")
    kind = (
        F.when(d.contains("Start of stimulation"), "S").when(d.contains("End of stimulation"), "E")
        .when(d.contains("5000"), "F").when(d.contains("2001"), "M")
    )
    first = annotations.filter(d.contains("5000")).groupBy("recording_id").agg(F.min("onset").alias("_t0"))
    known = spread_join(annotations, first, ["recording_id"], "onset").filter(F.col("onset") >= F.col("_t0"))
    known = known.select("recording_id", kind.alias("kind"), "onset", "event_id").filter("kind IS NOT NULL")
    nth = sequence_index(known, ["recording_id", "kind"], ["onset", "event_id"], "n")
    pick = lambda k, i: F.max(F.when((F.col("kind") == k) & (F.col("n") == i), F.col("onset"))).alias(f"{k}{i}")
    wide = nth.groupBy("recording_id").agg(
        *[pick(k, i) for k in "SEM" for i in range(3)],
        F.count_if(F.col("kind") == "S").alias("n_s"), F.count_if(F.col("kind") == "E").alias("n_e"),
        F.max(F.when(F.col("kind") == "M", F.col("onset"))).alias("m_last"),
    ).filter((F.col("n_s") == F.col("n_e")) & F.col("S2").isNotNull() & F.col("M2").isNotNull())
    sham = F.col("E0") - F.col("S0") < sham_below
    blocks = [("baseline1", F.col("S0") - offset - length, F.col("S0") - offset)]
    for i in range(3):
        m = F.when(~sham & (F.col("n_e") == i + 1), F.col("m_last")).otherwise(F.col(f"M{i}"))
        blocks.append((f"off{i + 1}", F.when(sham, F.col(f"M{i}") - length).otherwise(F.col(f"E{i}") + offset), m))
        if i < 2:
            blocks.append((f"baseline{i + 2}", F.col(f"M{i}"), F.col(f"S{i + 1}") - offset))
    rows = F.array(*[F.struct(F.lit(n).alias("block"), a.cast("bigint").alias("start_s"), b.cast("bigint").alias("end_s"))
                     for n, a, b in blocks])
    return wide.select("recording_id", F.when(sham, "sham").otherwise("active").alias("kind"), F.explode(rows).alias("b")).select(
        "recording_id", "kind", "b.*")


def file_offsets(files: DataFrame) -> DataFrame:
    """Start of every file on the joint time axis: samples of all earlier files in natural order."""
    chunked = range_chunks(files, ["recording_id"], ["natural"])
    return running(chunked, ["recording_id"], ["natural"], {"offset": ("sum", F.col("n_samples"))}, inclusive=False).drop(CHUNK)


def concat_recordings(signals: DataFrame, annotations: DataFrame, files: DataFrame, fs: float) -> tuple[DataFrame, DataFrame]:
    """Put the files of a recording one after the other; annotations move by the same offset in seconds."""
    off = file_offsets(files).select("recording_id", "file", F.col("offset").cast("bigint").alias("_off"))
    keys = ["recording_id", "file"]
    s = lookup_join(signals, off, keys).withColumn("sample_idx", F.col("sample_idx") + F.col("_off")).drop("_off")
    a = lookup_join(annotations, off, keys).withColumn("onset", F.col("onset") + F.col("_off") / F.lit(float(fs))).drop("_off")
    return s, a


def trim_at_end_marker(signals: DataFrame, annotations: DataFrame, fs: float, order: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """Cut after the first annotation containing "recording ends" when it ends more than 0.1 s before the data."""
    ends = annotations.filter(F.lower("description").contains("recording ends")).groupBy("recording_id").agg(
        F.min_by(F.col("onset") + F.col("duration"), F.struct("onset", order)).alias("_cut")
    )
    last = signals.groupBy("recording_id").agg((F.max("sample_idx") / F.lit(float(fs))).alias("_t"))
    cut = ends.join(last, "recording_id").filter(F.col("_cut") < F.col("_t") - 0.1).select("recording_id", "_cut")
    s = lookup_join(signals, cut, ["recording_id"], "left").filter(
        F.col("_cut").isNull() | (F.col("sample_idx") / F.lit(float(fs)) <= F.col("_cut")))
    a = lookup_join(annotations, cut, ["recording_id"], "left").filter(
        F.col("_cut").isNull() | (F.col("onset") <= F.col("_cut")))
    return s.drop("_cut"), a.drop("_cut")


def drop_boundary(annotations: DataFrame) -> DataFrame:
    return annotations.filter(~F.lower("description").contains("boundary"))


def annotate_bad_epochs(bad: DataFrame, totals: DataFrame, length: float, existing: DataFrame | None = None) -> DataFrame:
    """One ``bad_epoch_<i>`` annotation per bad epoch, cut at the end of the data; ``i`` counts bad epochs."""
    nth = sequence_index(bad.select("recording_id", "epoch_idx").distinct(), ["recording_id"], ["epoch_idx"], "_i")
    onset = F.col("epoch_idx") * F.lit(float(length))
    out = spread_join(nth, totals.select("recording_id", "total"), ["recording_id"], "epoch_idx").select(
        "recording_id", onset.alias("onset"), F.least(F.lit(float(length)), F.col("total") - onset).alias("duration"),
        F.concat(F.lit("bad_epoch_"), F.col("_i").cast("string")).alias("description"),
    ).filter("duration > 0")
    return out if existing is None else existing.select(*out.columns).unionByName(out)


def _walk(o: np.ndarray, start: int, gap: float) -> list[int]:
    """Positions kept when the walk over sorted values begins at ``start``."""
    kept, i = [], start
    while i < len(o):
        kept.append(i)
        j = max(i + 1, int(np.searchsorted(o, o[i] + gap)) - 1)
        while j < len(o) and not o[j] - o[i] > gap:
            j += 1
        i = j
    return kept


def _exits(o: np.ndarray, gap: float) -> tuple[list[float], list[float]]:
    """The values a walk can enter a chunk at, and the last value it keeps from each.

    The last kept value before the chunk is at most its first value, so entry happens no later than at the
    first value more than ``gap`` above it. Walks are followed backwards once for the whole chunk.
    """
    nxt = np.searchsorted(o, o + gap, side="right")
    last = np.arange(len(o))
    for i in range(len(o) - 1, -1, -1):
        j = int(nxt[i])
        while j - 1 > i and o[j - 1] - o[i] > gap:
            j -= 1
        while j < len(o) and not o[j] - o[i] > gap:
            j += 1
        last[i] = last[j] if j < len(o) else i
    n = 1
    while n < len(o) and not o[n - 1] - o[0] > gap:
        n += 1
    return o[:n].tolist(), o[last[:n]].tolist()


def _entered(entry: np.ndarray, state: float, gap: float) -> int:
    """Place of the first entry more than ``gap`` above ``state``; the length if there is none."""
    i = int(np.searchsorted(entry, state + gap, side="right"))
    while i > 0 and entry[i - 1] - state > gap:
        i -= 1
    while i < len(entry) and not entry[i] - state > gap:
        i += 1
    return i


def _after(entry: np.ndarray, exits: np.ndarray, state: float | None, gap: float) -> float:
    """The last kept value after a stretch that begins with ``state`` as the last kept one."""
    i = 0 if state is None or np.isnan(state) else _entered(entry, state, gap)
    return float(exits[i]) if i < len(entry) else state


def _joined(one: dict, two: dict, gap: float) -> tuple[list[float], list[float]]:
    """The summary of two neighbouring stretches.

    Only entries up to the first one more than ``gap`` above the first value can be reached; of neighbours with
    the same exit the last one decides, except that the first value stays.
    """
    e1, e2, x2 = (np.asarray(v, float) for v in (one["entry"], two["entry"], two["exit"]))
    entry = np.concatenate((e1, e2))
    leave = np.concatenate(([_after(e2, x2, x, gap) for x in one["exit"]], x2))
    far = np.flatnonzero(entry - entry[0] > gap)
    n = int(far[0]) + 1 if len(far) else len(entry)
    keep = np.append(leave[1:n] != leave[:n - 1], True)
    keep[0] = True
    return entry[:n][keep].tolist(), leave[:n][keep].tolist()


def keep_spaced(df: DataFrame, keys: list[str], order: str, gap: float, parts: int | None = None) -> DataFrame:
    """Keep the first row of a key and every later one more than ``gap`` after the last kept one.

    The rule is sequential, but a balanced chunk can be summarised without its past: for each possible entry
    the last value it keeps. Summaries of neighbouring chunks are composed pairwise, round by round, up to the whole key, and
    on the way back each pair tells its halves in which state they begin; then all chunks are walked in parallel. Every
    round is a written table and puts two summaries together, whatever the number of chunks of a key.
    """
    kind = df.schema[order].dataType.simpleString()
    chunked = range_chunks(df.select(*keys, order).distinct(), keys, [order], parts)
    packed = chunked.groupBy(*keys, CHUNK).agg(F.array_sort(F.collect_list(order)).alias("_o"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(CHUNK)) - 1  # one number per chunk
    packed = materialize(packed)
    packed = packed.join(packed.select(*keys, CHUNK, nth.cast("bigint").alias("_i")), [*keys, CHUNK]).drop(CHUNK)

    @F.pandas_udf("entry array<double>, exit array<double>")
    def summarise(chunks: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_exits(np.asarray(o, dtype=float), gap) for o in chunks], columns=["entry", "exit"])

    @F.pandas_udf("entry array<double>, exit array<double>")
    def compose(pairs: pd.Series) -> pd.DataFrame:
        out = [(p[0]["entry"], p[0]["exit"]) if len(p) == 1 else _joined(*p, gap) for p in pairs]
        return pd.DataFrame(out, columns=["entry", "exit"])

    @F.pandas_udf("double")
    def leave(entry: pd.Series, exits: pd.Series, before: pd.Series) -> pd.Series:
        return pd.Series([_after(np.asarray(e), np.asarray(x), b, gap) for e, x, b in zip(entry, exits, before)], dtype=float)

    @F.pandas_udf(f"array<{kind}>")
    def walk(chunks: pd.Series, before: pd.Series) -> pd.Series:
        out = []
        for o, b in zip(chunks, before):
            o = np.asarray(o)
            start = 0 if b is None or np.isnan(b) else _entered(o.astype(float), b, gap)
            out.append([o[i] for i in _walk(o, start, gap)])
        return pd.Series(out, dtype=object)

    levels = [materialize(packed.select(*keys, "_i", summarise("_o").alias("_s")))]
    half = F.floor(F.col("_i") / 2).cast("bigint")
    longest = packed.agg(F.max("_i")).first()[0] or 0
    while longest > 0:
        two = levels[-1].groupBy(*keys, half.alias("_i")).agg(F.array_sort(F.collect_list(F.struct("_i", "_s.entry", "_s.exit"))).alias("_p"))
        levels.append(materialize(two.select(*keys, "_i", compose("_p").alias("_s"))))
        longest //= 2
    states = levels.pop().select(*keys, "_i", F.lit(None).cast("double").alias("_before"))
    for level in reversed(levels):
        left = level.filter("_i % 2 = 0").select(*keys, half.alias("_i"), "_s")
        met = left.join(states, [*keys, "_i"]).withColumn("_then", leave("_s.entry", "_s.exit", "_before"))
        sides = F.array(F.struct((F.col("_i") * 2).alias("_i"), "_before"), F.struct((F.col("_i") * 2 + 1).alias("_i"), F.col("_then").alias("_before")))
        told = met.select(*keys, F.explode(sides).alias("_c")).select(*keys, "_c.*")
        states = materialize(level.select(*keys, "_i").join(told, [*keys, "_i"]))
        drop_table(level)
    return packed.join(states, [*keys, "_i"]).select(*keys, F.explode(walk("_o", "_before")).alias(order))
