"""Queries of the stimulation experiment as one plan."""

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import stimulation as stm
from ..operators.cleaning import JOINT
from ..plans.chunks import sequence_index
from . import fixtures as fx
from .artifacts_q import NAMES, POS, component_labels, layout
from .events_q import _IS_MARKER
from .registry import query, rounded
from .stats_q import _P
from .stats_q import W as _PSD

FS = 16.0


@fx.once
def sample_annotations(spark, sf):
    """The texts of the event recordings on the time axis of their samples: five channels, so five events a sample."""
    a = fx.annotations(spark, sf).withColumnRenamed("onset", "_t")
    at = sequence_index(a, ["recording_id"], ["_t", "event_id"], "_p")
    return at.select("recording_id", "event_id", (F.col("_p") / F.lit(5 * FS)).alias("onset"), "duration", "description")


def report(spark, sf, before, after, **how):
    return stm.stimulation_report(fx.signals(spark, sf), sample_annotations(spark, sf), FS, before, after, 16, report_channels=NAMES, **how)


# markers more than 3 s apart and not in the last 10 s, their segments, and the windows of one second in them
_WINDOWS = "WITH RECURSIVE " + fx.SIGNALS + ",\n" + fx.ANNOTATIONS + f""",
an AS (SELECT recording_id, event_id, description, (row_number() OVER (PARTITION BY recording_id ORDER BY onset, event_id) - 1) / 80.0::DOUBLE AS onset FROM annotations),
tot AS (SELECT recording_id, max(sample_idx) / 16.0::DOUBLE AS total FROM signals GROUP BY 1),
once AS (SELECT recording_id, onset, arg_min(trim(description), event_id) AS sequence, min(onset) OVER (PARTITION BY recording_id) AS first
  FROM an WHERE {_IS_MARKER} GROUP BY recording_id, onset),
allowed AS MATERIALIZED (SELECT recording_id, onset FROM once JOIN tot USING (recording_id) WHERE onset = first OR total - onset > 10),
nxt AS MATERIALIZED (SELECT a.recording_id, a.onset, min(b.onset) AS nx FROM allowed a JOIN allowed b ON a.recording_id = b.recording_id AND b.onset - a.onset > 3 GROUP BY ALL),
kept AS (SELECT recording_id, min(onset) AS onset FROM allowed GROUP BY 1 UNION ALL SELECT n.recording_id, n.nx FROM kept k JOIN nxt n ON n.recording_id = k.recording_id AND n.onset = k.onset),
sg AS (SELECT recording_id, row_number() OVER w - 1 AS segment_idx, onset AS s, lead(onset) OVER w AS e FROM kept WINDOW w AS (PARTITION BY recording_id ORDER BY onset)),
mk AS (SELECT a.recording_id, segment_idx, s, min(onset) FILTER (contains(description, 'Start of stimulation')) AS st,
    max(onset) FILTER (contains(description, 'End of stimulation') OR contains(description, '2000')) AS en
  FROM an a JOIN sg ON sg.recording_id = a.recording_id AND onset BETWEEN s AND e GROUP BY ALL),
tasks AS (SELECT recording_id, segment_idx, 'before' AS condition, s AS tmin, s + 1 AS tmax FROM mk WHERE st IS NOT NULL
  UNION ALL SELECT recording_id, segment_idx, 'after', en, en + 1 FROM mk WHERE en IS NOT NULL)"""
_CUT = _WINDOWS + """,
halves AS (SELECT recording_id, condition, segment_idx, channel, sample_idx - CAST(trunc(tmin * 16) AS BIGINT) AS sample_idx, value FROM signals JOIN tasks USING (recording_id)
  WHERE sample_idx >= trunc(tmin * 16) AND sample_idx < trunc(tmax * 16))"""
_SPECTRA = _CUT + fx.PSD[len(fx.HALVES):]
_TESTS = _SPECTRA + _P[len(_PSD):]


@query("stim_windows", _WINDOWS + """
SELECT recording_id, segment_idx, condition, round(tmin, 6) + 0 AS tmin, round(tmax, 6) + 0 AS tmax FROM tasks""")
def windows(spark, sf):
    return rounded(report(spark, sf, (0.0, 1.0), (0.0, 1.0))["windows"], "tmin", "tmax")


@query("stim_cut_windows", _CUT + " SELECT recording_id, condition, segment_idx, channel, sample_idx, value FROM halves")
def cut(spark, sf):
    s = fx.signals(spark, sf)
    totals = s.groupBy("recording_id").agg((F.max("sample_idx") / FS).alias("total"))
    return stm.cut_windows(s, stm.analysis_windows(sample_annotations(spark, sf), totals, (0.0, 1.0), (0.0, 1.0)), FS)


@query("stim_report_tests", _TESTS + """,
rk AS (SELECT *, p * count(*) OVER (PARTITION BY recording_id, channel) / row_number() OVER (PARTITION BY recording_id, channel ORDER BY p) AS q,
    row_number() OVER (PARTITION BY recording_id, channel ORDER BY p) AS k FROM pt),
fd AS (SELECT *, least(1, min(q) OVER (PARTITION BY recording_id, channel ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS p_adj FROM rk)
SELECT recording_id, channel, freq, n, round(t, 5) + 0 AS t, round(p, 6) + 0 AS p, round(p_adj, 6) + 0 AS p_adj, p_adj <= 0.05 AS reject FROM fd""")
def tests(spark, sf):
    return rounded(rounded(report(spark, sf, (0.0, 1.0), (0.0, 1.0))["tests"], "p", "p_adj"), "t", digits=5)


@query("stim_report_mean", _SPECTRA + """
SELECT recording_id, condition, channel, freq, count(*) AS n, round(avg(power_db), 6) + 0 AS mean_db, round(stddev_pop(power_db) / sqrt(count(*)), 6) + 0 AS sem_db FROM psd GROUP BY ALL""")
def mean(spark, sf):
    return rounded(report(spark, sf, (0.0, 1.0), (0.0, 1.0))["mean"], "mean_db", "sem_db")


@query("stim_report_cleaned")
def cleaned(spark, sf):
    """Windows of two seconds, each a recording of its own: filtered by type, without the components that are not brain, and
    with epochs of a quarter second repaired."""
    out = report(spark, sf, (0.0, 2.0), (0.0, 2.0), channels=layout(spark, sf), names=NAMES, positions=POS, use_ica=True,
                 ica_labels=component_labels(spark, sf), epoch_seconds=0.25, rules=replace(JOINT, epoch_z=1.5, channel_z=1.5))
    return rounded(out["tests"], "t", "p", "p_adj")
