"""Filter, artifact and component queries."""

import numpy as np
from pyspark.sql import functions as F

from ..operators import artifacts as art
from ..operators import cleaning
from ..operators import filters as fl
from ..operators import ica, keyed_ica
from ..operators import signals as sg
from ..operators import windows as wn
from ..plans.joins import spread_join
from . import fixtures as fx
from .recursion_sql import filtfilt_sql
from .registry import query, rounded
from .signals_q import PEAKS, peaks
from .windows_q import flat_sql

SERIES = ["recording_id", "channel"]
W = "WITH " + fx.SIGNALS
RECT = fx.SIGNALS + """,
rect AS (SELECT * FROM (SELECT *, min(n) OVER (PARTITION BY recording_id) AS short FROM
  (SELECT *, count(*) OVER (PARTITION BY recording_id, channel) AS n FROM signals)) WHERE sample_idx < short)"""
NAMES = sorted(fx.CODE)
# unit-sphere positions for the five event channels
POS = {"click": (0.0, 0.6, 0.8), "error": (0.6, 0.0, 0.8), "purchase": (-0.6, 0.0, 0.8), "signup": (0.0, -0.6, 0.8), "view": (0.0, 0.0, 1.0)}


def rect(spark, sf):
    return sg.trim_to_shortest(fx.signals(spark, sf))


def layout(spark, sf):
    """Channel table of the event recordings with types and positions."""
    c = fx.signals(spark, sf).select(*SERIES).distinct()
    pos = F.create_map(*[x for k, v in POS.items() for x in (F.lit(k), F.struct(*[F.lit(a).alias(b) for a, b in zip(v, "xyz")]))])
    return c.withColumn("ch_type", F.lit("eeg")).withColumn("pos", pos[F.col("channel")])


def typed(spark, sf):
    kind = {"click": "eeg", "error": "eog", "purchase": "emg", "signup": "ecg", "view": "misc"}
    m = F.create_map(*[x for k, v in kind.items() for x in (F.lit(k), F.lit(v))])
    return layout(spark, sf).withColumn("ch_type", m[F.col("channel")])


def _fir_sql(taps) -> str:
    """Zero-phase FIR of every series with point reflection at both ends, as dot products of list slices."""
    vals = "[" + ", ".join(repr(float(t)) for t in taps) + "]::DOUBLE[]"
    h = len(taps) // 2
    return W + f""",
xs AS (SELECT recording_id, channel, list(value ORDER BY sample_idx) AS x, count(*) AS n, least({h}, count(*) - 1) AS m FROM signals GROUP BY ALL),
ext AS (SELECT recording_id, channel, n, list_resize([]::DOUBLE[], {h} - m, 0.0::DOUBLE) || [2 * x[1] - x[k] for k in range(m + 1, 1, -1)] || x
    || [2 * x[n] - x[k] for k in range(n - 1, n - 1 - m, -1)] || list_resize([]::DOUBLE[], {h} - m, 0.0::DOUBLE) AS e FROM xs),
i AS (SELECT recording_id, channel, e, unnest(range(n)) AS i FROM ext)
SELECT recording_id, channel, i AS sample_idx, round(list_dot_product(e[i + 1:i + {2 * h + 1}], {vals}), 6) + 0 AS value FROM i"""


def _bandpass_oracle():
    from ..functions.signal import bandpass_taps

    return _fir_sql(bandpass_taps(16.0, 2.0, 5.0))


@query("sig1_fir_bandpass", _bandpass_oracle())
def sig1(spark, sf):
    return rounded(fl.fir_bandpass(fx.signals(spark, sf), 16.0, 2.0, 5.0), "value")


@query("sig1_fir_by_type")
def sig1b(spark, sf):
    return rounded(fl.fir_filter(fx.signals(spark, sf), fl.type_taps(256.0), typed(spark, sf)), "value")


def _notch_oracle():
    from ..functions.signal import notch_taps

    return _fir_sql(notch_taps(128.0, [50.0]))


@query("sig2_notch", _notch_oracle())
def sig2(spark, sf):
    return rounded(fl.notch(fx.signals(spark, sf), 128.0, [50.0]), "value")


RW = "WITH RECURSIVE " + fx.SIGNALS + ",\n"
_FILTERED = " SELECT recording_id, channel, sample_idx, round(value, 6) + 0 AS value FROM filtered"


@query("sig3_butter_filtfilt", RW + filtfilt_sql(128.0, 4, (20.0, None)) + _FILTERED)
def sig3(spark, sf):
    return rounded(fl.butter_filtfilt(fx.signals(spark, sf), 128.0, 4, (20.0, None)), "value")


@query("sig3_butter_bandpass", RW + filtfilt_sql(128.0, 2, (8.0, 30.0)) + _FILTERED)
def sig3b(spark, sf):
    return rounded(fl.butter_filtfilt(fx.signals(spark, sf), 128.0, 2, (8.0, 30.0)), "value")


@query("sig3_butter_slow", RW + filtfilt_sql(128.0, 2, (0.1, None)) + _FILTERED.replace(", 6)", ", 4)"))
def sig3c(spark, sf):
    """A response of some 10,000 samples over blocks of 128: the blocks exchange filter states."""
    return rounded(fl.butter_filtfilt(fx.signals(spark, sf), 128.0, 2, (0.1, None), block=128), "value", digits=4)


@query("sig4_detrend_linear", W + """,
l AS (SELECT recording_id, channel, regr_slope(value, sample_idx) AS b, regr_intercept(value, sample_idx) AS a FROM signals GROUP BY ALL)
SELECT recording_id, channel, sample_idx, round(value - a - b * sample_idx, 6) + 0 AS value FROM signals JOIN l USING (recording_id, channel)""")
def sig4(spark, sf):
    return rounded(fl.detrend_linear(fx.signals(spark, sf)), "value")


def _lerp(fs, fs2, start=W, source="signals", digits=8):
    return start + f""",
n AS (SELECT recording_id, channel, max(sample_idx) + 1 AS n, CAST(floor((max(sample_idx) + 1) / {fs}::DOUBLE * {fs2}::DOUBLE) AS BIGINT) AS n2 FROM {source} GROUP BY ALL),
j AS (SELECT recording_id, channel, n, n2, unnest(range(n2)) AS j FROM n)
SELECT j.recording_id, j.channel, j AS sample_idx, round(a.value + (coalesce(b.value, a.value) - a.value) * ((j * n % n2) / n2), {digits}) + 0 AS value
FROM j JOIN {source} a ON a.recording_id = j.recording_id AND a.channel = j.channel AND a.sample_idx = j * n // n2
LEFT JOIN {source} b ON b.recording_id = j.recording_id AND b.channel = j.channel AND b.sample_idx = j * n // n2 + 1"""


@query("sig5_resample_linear_up", _lerp(16.0, 25.0))
def sig5(spark, sf):
    return rounded(fl.resample_linear(fx.signals(spark, sf), 16.0, 25.0), "value", digits=8)


@query("sig5_resample_linear_down", _lerp(16.0, 7.0))
def sig5b(spark, sf):
    return rounded(fl.resample_linear(fx.signals(spark, sf), 16.0, 7.0), "value", digits=8)


@query("sig5_resample_record", "SELECT recording_id, channel, sample_idx, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) + 0 AS value FROM ("
       + _lerp(200.0, 128.0, RW + filtfilt_sql(200.0, 4, (None, 64.0)), "filtered", 15) + ") WINDOW w AS (PARTITION BY recording_id, channel)")
def sig5c(spark, sf):
    return rounded(fl.resample_record(fx.signals(spark, sf), 200.0, 128.0), "value")


@query("sig6_resample_bandlimited", W + """,
n AS (SELECT recording_id, channel, max(sample_idx) + 1 AS n, arg_min(value, sample_idx) AS first, arg_max(value, sample_idx) AS last FROM signals GROUP BY ALL),
ext AS (
  SELECT recording_id, channel, sample_idx AS i, value AS x FROM signals
  UNION ALL SELECT recording_id, channel, -sample_idx, 2 * first - value FROM signals JOIN n USING (recording_id, channel) WHERE sample_idx BETWEEN 1 AND 51
  UNION ALL SELECT recording_id, channel, 2 * (n - 1) - sample_idx, 2 * last - value FROM signals JOIN n USING (recording_id, channel) WHERE sample_idx BETWEEN n - 52 AND n - 2),
j AS (SELECT recording_id, channel, unnest(range(CAST(round(n * 0.64::DOUBLE) AS BIGINT))) AS j FROM n),
k AS (SELECT *, j / 0.64::DOUBLE AS t, CAST(floor(j / 0.64::DOUBLE) AS BIGINT) + o AS i FROM j, (SELECT unnest(range(-49, 51)) AS o)),
d AS (SELECT *, (t - i) * 0.64::DOUBLE AS d FROM k),
w AS (SELECT *, CASE WHEN abs(d) < 32 THEN CASE WHEN d = 0 THEN 1 ELSE sin(pi() * d) / (pi() * d) END * (0.5 + 0.5 * cos(pi() * d / 32)) ELSE 0 END AS w FROM d)
SELECT w.recording_id, w.channel, j AS sample_idx, round(sum(coalesce(x, 0) * w) / sum(w), 6) + 0 AS value
FROM w LEFT JOIN ext USING (recording_id, channel, i) GROUP BY ALL""")
def sig6(spark, sf):
    return rounded(fl.resample_bandlimited(fx.signals(spark, sf), 200.0, 128.0), "value")


@query("art1_flat_channels", "WITH " + flat_sql(4, 60.0) + " SELECT recording_id, channel FROM flat WHERE longest >= 2")
def art1(spark, sf):
    return art.flat_channels(fx.signals(spark, sf), 4.0, 2.0, 60.0)


def _mad_sql(name: str) -> str:
    return f"""{name}_m AS (SELECT recording_id, channel, median(value) AS m FROM {name} GROUP BY ALL),
{name}_mad AS (SELECT recording_id, channel, median(abs(value - m)) / 0.6744897501960817::DOUBLE AS mad FROM {name} JOIN {name}_m USING (recording_id, channel) GROUP BY ALL)"""


@query("art2_hf_noise_channels", RW + filtfilt_sql(128.0, 4, (20.0, None), "hp") + ",\n" + filtfilt_sql(128.0, 4, (None, 30.0), "lp") + f""",
{_mad_sql("hp")},
{_mad_sql("lp")},
r AS (SELECT recording_id, channel, hp_mad.mad / lp_mad.mad AS ratio FROM hp_mad JOIN lp_mad USING (recording_id, channel)),
c AS (SELECT *, abs(ratio - median(ratio) OVER (PARTITION BY recording_id)) AS d, median(ratio) OVER (PARTITION BY recording_id) AS m FROM r)
SELECT recording_id, channel, round(ratio, 6) + 0 AS ratio,
  round((ratio - m) / (median(d) OVER (PARTITION BY recording_id) / 0.6744897501960817::DOUBLE), 6) + 0 AS z FROM c""")
def art2(spark, sf):
    return rounded(art.hf_noise(fx.signals(spark, sf), 128.0), "ratio", "z")


def _nearest(k: int = 3) -> str:
    """The fixed layout's nearest channels as rows of SQL."""
    rows = []
    for c, at in POS.items():
        others = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(POS[o], at)))), o) for o in POS if o != c)
        rows.append("(" + ", ".join(f"'{n}'" for n in [c, *[o for _, o in others[:k]]]) + ")")
    return f"near(channel, n1, n2, n3) AS (VALUES {', '.join(rows)})"


# consensus of 20 planes through three points each; the minimum-norm plane lies in the span of the differences of its points
_CONSENSUS = _nearest() + """,
d AS (SELECT a.recording_id, a.channel, a.sample_idx, a.value AS y, b.value AS x1, c.value AS x2, e.value AS x3 FROM rect a JOIN near USING (channel)
  JOIN rect b ON b.recording_id = a.recording_id AND b.sample_idx = a.sample_idx AND b.channel = n1
  JOIN rect c ON c.recording_id = a.recording_id AND c.sample_idx = a.sample_idx AND c.channel = n2
  JOIN rect e ON e.recording_id = a.recording_id AND e.sample_idx = a.sample_idx AND e.channel = n3),
dm AS (SELECT recording_id, channel, median(y) AS m, max(sample_idx) + 1 AS n FROM d GROUP BY ALL),
dl AS (SELECT recording_id, channel, median(abs(y - m)) AS most FROM d JOIN dm USING (recording_id, channel) GROUP BY ALL),
cp AS (SELECT recording_id, channel, cand, pt, (3 * cand + pt + 43) * 2654435761 % n AS sample_idx
  FROM dm, (SELECT unnest(range(20)) AS cand), (SELECT unnest(range(3)) AS pt)),
pv AS (SELECT recording_id, channel, cand, list({'y': y, 'x1': x1, 'x2': x2, 'x3': x3} ORDER BY pt) AS p FROM cp JOIN d USING (recording_id, channel, sample_idx) GROUP BY ALL),
df AS (SELECT recording_id, channel, cand, p[1] AS o, p[2].y - p[1].y AS f1, p[3].y - p[1].y AS f2,
    [p[2].x1 - p[1].x1, p[2].x2 - p[1].x2, p[2].x3 - p[1].x3] AS e1, [p[3].x1 - p[1].x1, p[3].x2 - p[1].x2, p[3].x3 - p[1].x3] AS e2 FROM pv),
gr AS (SELECT *, list_dot_product(e1, e1) AS g11, list_dot_product(e1, e2) AS g12, list_dot_product(e2, e2) AS g22 FROM df),
wt AS (SELECT *, (g22 * f1 - g12 * f2) / (g11 * g22 - g12 * g12) AS w1, (g11 * f2 - g12 * f1) / (g11 * g22 - g12 * g12) AS w2 FROM gr),
cm AS (SELECT recording_id, channel, cand, o, [w1 * e1[i] + w2 * e2[i] for i in range(1, 4)] AS c FROM wt),
hit AS (SELECT recording_id, channel, cand, count(*) AS hits, any_value(c) AS c, any_value(o) AS o FROM d JOIN cm USING (recording_id, channel) JOIN dl USING (recording_id, channel)
  WHERE abs(y - o.y - c[1] * (x1 - o.x1) - c[2] * (x2 - o.x2) - c[3] * (x3 - o.x3)) <= most GROUP BY ALL),
won AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY recording_id, channel ORDER BY hits DESC, cand) = 1),
mo AS (SELECT recording_id, channel, covar_pop(x1, x1) AS a, covar_pop(x1, x2) AS b, covar_pop(x1, x3) AS c, covar_pop(x2, x2) AS e, covar_pop(x2, x3) AS f, covar_pop(x3, x3) AS g,
    covar_pop(x1, y) AS u, covar_pop(x2, y) AS v, covar_pop(x3, y) AS w
  FROM d JOIN won USING (recording_id, channel) JOIN dl USING (recording_id, channel)
  WHERE abs(y - o.y - won.c[1] * (x1 - o.x1) - won.c[2] * (x2 - o.x2) - won.c[3] * (x3 - o.x3)) <= most GROUP BY ALL),
fit AS (SELECT recording_id, channel, u * (e * g - f * f) - v * (b * g - c * f) + w * (b * f - c * e) AS k1,
    -u * (b * g - c * f) + v * (a * g - c * c) - w * (a * f - b * c) AS k2, u * (b * f - c * e) - v * (a * f - b * c) + w * (a * e - b * b) AS k3,
    a * (e * g - f * f) - b * (b * g - f * c) + c * (b * f - e * c) AS det FROM mo),
nc AS (SELECT recording_id, channel, abs(corr((k1 * x1 + k2 * x2 + k3 * x3) / det, y)) AS corr FROM d JOIN fit USING (recording_id, channel) GROUP BY ALL)"""


@query("art3_low_corr_channels", "WITH " + RECT + ",\n" + _CONSENSUS + " SELECT recording_id, channel, round(corr, 6) + 0 AS corr FROM nc")
def art3(spark, sf):
    return rounded(art.neighbor_correlation(rect(spark, sf), layout(spark, sf)), "corr")


@query("art4_bad_channels", "WITH RECURSIVE " + flat_sql(16, 1e-6) + """,
rect AS (SELECT * FROM (SELECT *, min(n) OVER (PARTITION BY recording_id) AS short FROM
  (SELECT *, count(*) OVER (PARTITION BY recording_id, channel) AS n FROM signals)) WHERE sample_idx < short),
""" + filtfilt_sql(16.0, 4, (4.0, None), "hp", "rect") + ",\n" + filtfilt_sql(16.0, 4, (None, 6.0), "lp", "rect") + f""",
{_mad_sql("hp")},
{_mad_sql("lp")},
r AS (SELECT recording_id, channel, hp_mad.mad / lp_mad.mad AS ratio FROM hp_mad JOIN lp_mad USING (recording_id, channel)),
cz AS (SELECT *, abs(ratio - median(ratio) OVER (PARTITION BY recording_id)) AS d, median(ratio) OVER (PARTITION BY recording_id) AS m FROM r),
z AS (SELECT *, (ratio - m) / (median(d) OVER (PARTITION BY recording_id) / 0.6744897501960817::DOUBLE) AS z FROM cz),
""" + _CONSENSUS + """
SELECT recording_id, channel FROM flat WHERE longest >= 5 UNION SELECT recording_id, channel FROM z WHERE z > 0.5
UNION SELECT recording_id, channel FROM nc WHERE corr < 0.05""")
def art4(spark, sf):
    """Thresholds under which some channels of random events stay good."""
    s, chans = rect(spark, sf), layout(spark, sf)
    return art.detect_bad_channels(s, chans, 16.0, corr_threshold=0.05, noise_z=0.5, high=4.0, low=6.0)


_D = ["recording_id", "channel", "variance", "kurtosis", "hurst", "correlation"]


@query("art5_faster_channel_metrics", "WITH " + RECT + """,
d AS (SELECT *, sample_idx AS i, value - 2 * lag(value, 1) OVER w + lag(value, 2) OVER w AS d1, value - 2 * lag(value, 2) OVER w + lag(value, 4) OVER w AS d2
  FROM rect WINDOW w AS (PARTITION BY recording_id, channel ORDER BY sample_idx)),
m AS (SELECT recording_id, channel, var_pop(value) AS variance, kurtosis_pop(value) AS kurtosis,
    0.5 * log2(avg(d2 * d2) FILTER (i >= 5 AND i < short - 1) / avg(d1 * d1) FILTER (i >= 3 AND i < short - 1)) AS hurst FROM d GROUP BY ALL),
c AS (SELECT a.recording_id, a.channel, avg(cc) AS correlation FROM (SELECT a.recording_id, a.channel, b.channel AS o, corr(a.value, b.value) AS cc
  FROM rect a JOIN rect b ON a.recording_id = b.recording_id AND a.sample_idx = b.sample_idx AND a.channel <> b.channel GROUP BY ALL) a GROUP BY ALL)
SELECT recording_id, channel, round(variance, 4) + 0 AS variance, round(kurtosis, 6) + 0 AS kurtosis, round(hurst, 6) + 0 AS hurst, round(correlation, 6) + 0 AS correlation
FROM m JOIN c USING (recording_id, channel)""")
def art5(spark, sf):
    m = art.channel_metrics(rect(spark, sf), 128.0, 64)
    return rounded(rounded(m, "variance", digits=4), "kurtosis", "hurst", "correlation").select(*_D)


@query("art5_faster_channels")
def art5b(spark, sf):
    z = art.faster_channels(rect(spark, sf), 128.0, 64, 1.5)
    return rounded(z, *[f"z_{m}" for m in art.CHANNEL_METRICS]).select(*SERIES, *[f"z_{m}" for m in art.CHANNEL_METRICS], "is_bad")


_EPOCHS = """,
ep AS (SELECT recording_id, channel, sample_idx // 16 AS epoch_idx, sample_idx % 16 AS o, value FROM rect WHERE sample_idx < short // 16 * 16),
g AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY recording_id, channel, epoch_idx ORDER BY o)) AS g FROM ep),
st AS (SELECT recording_id, epoch_idx, channel, max(value) - min(value) AS amplitude, var_pop(value) AS variance, avg(value) AS mean, median(g) AS median_gradient FROM g GROUP BY ALL),
dv AS (SELECT *, mean - avg(mean) OVER (PARTITION BY recording_id, channel) AS deviation FROM st)"""


def _z(m, part):
    return f"({m} - avg({m}) OVER (PARTITION BY {part})) / stddev_pop({m}) OVER (PARTITION BY {part})"


@query("art6_faster_epochs", "WITH " + RECT + _EPOCHS + f""",
p AS (SELECT recording_id, epoch_idx, avg(amplitude) AS a, avg(variance) AS v, avg(deviation) AS d FROM dv GROUP BY ALL),
z AS (SELECT recording_id, epoch_idx, {_z('a', 'recording_id')} AS z_amplitude, {_z('v', 'recording_id')} AS z_variance, {_z('d', 'recording_id')} AS z_deviation FROM p)
SELECT recording_id, epoch_idx, round(z_amplitude, 6) + 0 AS z_amplitude, round(z_variance, 6) + 0 AS z_variance, round(z_deviation, 6) + 0 AS z_deviation,
  abs(z_amplitude) > 2 OR abs(z_variance) > 2 OR abs(z_deviation) > 2 AS is_bad FROM z""")
def art6(spark, sf):
    out = art.faster_epochs(wn.fixed_epochs(rect(spark, sf), 1.0, 16.0), 2.0)
    z = ["z_amplitude", "z_variance", "z_deviation"]
    return rounded(out, *z).select("recording_id", "epoch_idx", *z, "is_bad")


_CE = "recording_id, epoch_idx"


@query("art7_faster_channels_in_epochs", "WITH " + RECT + _EPOCHS + f""",
z AS (SELECT recording_id, epoch_idx, channel, {_z('amplitude', _CE)} AS z_amplitude, {_z('variance', _CE)} AS z_variance, {_z('deviation', _CE)} AS z_deviation,
  {_z('median_gradient', _CE)} AS z_median_gradient FROM dv)
SELECT recording_id, epoch_idx, channel, round(z_amplitude, 6) + 0 AS z_amplitude, round(z_variance, 6) + 0 AS z_variance, round(z_deviation, 6) + 0 AS z_deviation,
  round(z_median_gradient, 6) + 0 AS z_median_gradient, abs(z_amplitude) > 1.7 OR abs(z_variance) > 1.7 OR abs(z_deviation) > 1.7 OR abs(z_median_gradient) > 1.7 AS is_bad FROM z""")
def art7(spark, sf):
    out = art.faster_channels_in_epochs(wn.fixed_epochs(rect(spark, sf), 1.0, 16.0), 1.7)
    z = ["z_amplitude", "z_variance", "z_deviation", "z_median_gradient"]
    return rounded(out, *z).select("recording_id", "epoch_idx", "channel", *z, "is_bad")


_TABLE = W + """,
e AS (SELECT recording_id, channel, sample_idx // 16 AS epoch_idx, max(value) AS m FROM signals GROUP BY ALL),
t AS (SELECT recording_id, epoch_idx, max(m) > 250 AS is_bad, epoch_idx % 5 = 0 AS is_stim, coalesce(list(channel ORDER BY channel) FILTER (m > 120), []) AS bads FROM e GROUP BY ALL),
g AS (SELECT recording_id, list(DISTINCT channel ORDER BY channel) AS gl FROM signals WHERE value > 330 GROUP BY 1),
p AS (SELECT t.*, list_sort(list_distinct(list_concat(bads, coalesce(gl, [])))) AS alls FROM t LEFT JOIN g USING (recording_id))"""


def _epoch_table(spark, sf):
    s = fx.signals(spark, sf)
    e = s.groupBy("recording_id", "channel", F.floor(F.col("sample_idx") / 16).alias("epoch_idx")).agg(F.max("value").alias("m"))
    t = e.groupBy("recording_id", "epoch_idx").agg(
        (F.max("m") > 250).alias("is_bad"), F.array_sort(F.collect_list(F.when(F.col("m") > 120, F.col("channel")))).alias("bad_channels"))
    return t.withColumn("is_stim", F.col("epoch_idx") % 5 == 0), s.filter("value > 330").select(*SERIES).distinct()


def _show(df, *extra):
    return df.select("recording_id", "epoch_idx", "action", F.concat_ws(",", "bad_channels").alias("own"), *extra)


@query("art8_epoch_policy", _TABLE + """
SELECT recording_id, epoch_idx, array_to_string(bads, ',') AS own, array_to_string(alls, ',') AS alls,
  CASE WHEN is_bad OR len(alls) / 5 > 0.5 THEN 'marked_bad' WHEN len(bads) > 0 THEN 'repaired' ELSE 'none' END AS action FROM p""")
def art8(spark, sf):
    t, g = _epoch_table(spark, sf)
    return _show(art.epoch_policy(t, g, 5, 0.5), F.concat_ws(",", "all_bads").alias("alls"))


@query("art9_epoch_policy_stim", _TABLE + """
SELECT recording_id, epoch_idx, array_to_string(bads, ',') AS own, CASE WHEN NOT is_stim AND is_bad AND len(bads) > 1 THEN 'repaired' ELSE 'none' END AS action FROM p""")
def art9(spark, sf):
    return _show(art.epoch_policy_stim(_epoch_table(spark, sf)[0]))


@query("art10_epoch_policy_v2", _TABLE + """
SELECT recording_id, epoch_idx, array_to_string(bads, ',') AS own,
  CASE WHEN is_bad AND len(bads) / 5 > 0.2 THEN CASE WHEN len(alls) > 0.3 * 5 THEN 'interpolated' ELSE 'candidate' END ELSE 'none' END AS action FROM p""")
def art10(spark, sf):
    t, g = _epoch_table(spark, sf)
    return _show(art.epoch_policy_v2(t, g, 5))


def _spline_oracle():
    from ..functions.spline import spline_weights

    good = [c for c in NAMES if c != "view"]
    w = spline_weights(np.array([POS[c] for c in good]), np.array([POS["view"]]))[0]
    case = " ".join(f"WHEN '{c}' THEN {float(v)!r}::DOUBLE" for c, v in zip(good, w))
    return "WITH " + RECT + f"""
SELECT recording_id, channel, sample_idx, round(value, 6) + 0 AS value FROM rect WHERE channel <> 'view'
UNION ALL SELECT recording_id, 'view', sample_idx, round(sum(value * CASE channel {case} END), 6) + 0 FROM rect WHERE channel <> 'view' GROUP BY ALL"""


@query("art11_interpolate", _spline_oracle())
def art11(spark, sf):
    from ..plans.blocks import to_frames

    frames = to_frames(rect(spark, sf), NAMES).withColumn("bads", F.array(F.lit("view")))
    return rounded(cleaning.frames_to_signals(art.interpolate(frames, NAMES, POS), NAMES), "value")


@query("art12_clean")
def art12(spark, sf):
    out = cleaning.clean(rect(spark, sf), layout(spark, sf), NAMES, POS, 16.0)
    return rounded(out["signals"], "value")


@query("art12_clean_annotations")
def art12b(spark, sf):
    out = cleaning.clean(rect(spark, sf), layout(spark, sf), NAMES, POS, 16.0, max_bad_frac=0.15)
    return out["epochs"].select("recording_id", "epoch_idx", "action")


# the epoch decisions of the joint rules: z-scores over epochs and over the channels of an epoch, both beyond 1.5
@query("art12_clean_joint", "WITH " + RECT + _EPOCHS + f""",
p AS (SELECT recording_id, epoch_idx, avg(amplitude) AS a, avg(variance) AS v, avg(deviation) AS d FROM dv GROUP BY ALL),
ze AS (SELECT recording_id, epoch_idx, {_z('a', 'recording_id')} AS a, {_z('v', 'recording_id')} AS v, {_z('d', 'recording_id')} AS d FROM p),
zc AS (SELECT recording_id, epoch_idx, channel, {_z('amplitude', _CE)} AS a, {_z('variance', _CE)} AS v, {_z('deviation', _CE)} AS d, {_z('median_gradient', _CE)} AS g FROM dv),
bc AS (SELECT recording_id, epoch_idx, channel FROM zc WHERE abs(a) > 1.5 OR abs(v) > 1.5 OR abs(d) > 1.5 OR abs(g) > 1.5),
be AS (SELECT recording_id, epoch_idx, abs(a) > 1.5 OR abs(v) > 1.5 OR abs(d) > 1.5 AS is_bad, count(*) OVER (PARTITION BY recording_id) AS n FROM ze),
gl AS (SELECT recording_id, list(channel) AS gl FROM (SELECT b.recording_id, channel FROM bc b JOIN be USING (recording_id, epoch_idx)
  GROUP BY b.recording_id, channel HAVING count(*) / any_value(n) > 0.3) GROUP BY 1),
ow AS (SELECT recording_id, epoch_idx, list(channel ORDER BY channel) AS bads FROM bc GROUP BY ALL),
t AS (SELECT recording_id, epoch_idx, is_bad, coalesce(bads, []) AS bads, list_sort(list_distinct(list_concat(coalesce(bads, []), coalesce(gl, [])))) AS alls
  FROM be LEFT JOIN ow USING (recording_id, epoch_idx) LEFT JOIN gl USING (recording_id))
SELECT recording_id, epoch_idx, array_to_string(bads, ',') AS own, array_to_string(alls, ',') AS alls,
  CASE WHEN is_bad AND len(bads) / 5 > 0.2 THEN CASE WHEN len(alls) > 0.3 * 5 THEN 'interpolated' ELSE 'candidate' END ELSE 'none' END AS action FROM t""")
def art12c(spark, sf):
    rules = cleaning.Rules(epoch_z=1.5, channel_z=1.5, min_corr=0.5, joint=True)  # five channels never differ by more than 2
    out = cleaning.clean(rect(spark, sf), layout(spark, sf), NAMES, POS, 16.0, rules=rules)
    return _show(out["epochs"], F.concat_ws(",", "all_bads").alias("alls"))


@query("art12_clean_joint_signals")
def art12d(spark, sf):
    rules = cleaning.Rules(epoch_z=1.5, channel_z=1.5, min_corr=0.5, joint=True)
    out = cleaning.clean(rect(spark, sf), layout(spark, sf), NAMES, POS, 16.0, use_ica=True, ica_labels=component_labels(spark, sf), rules=rules)
    return rounded(out["signals"], "value")


@query("art13_detect_r_peaks")
def art13(spark, sf):
    ecg = fx.signals(spark, sf).filter("channel = 'signup'").select("recording_id", "sample_idx", "value")
    return art.detect_r_peaks(ecg, 32.0)


_TPL = "WITH " + PEAKS + """,
tpl AS (SELECT recording_id, channel, offs, median(value) AS template FROM win GROUP BY ALL)"""


@query("art14_ecg_template", _TPL + ' SELECT recording_id, channel, offs AS "offset", round(template, 6) + 0 AS template FROM tpl')
def art14(spark, sf):
    return rounded(art.ecg_template(fx.signals(spark, sf), peaks(spark, sf), 8, 8), "template")


@query("art15_subtract_template", _TPL + """,
sub AS (SELECT recording_id, channel, sample_idx, sum(template) AS t FROM win JOIN tpl USING (recording_id, channel, offs) GROUP BY ALL)
SELECT recording_id, channel, sample_idx, round(value - CASE WHEN channel = 'signup' THEN 0 ELSE coalesce(t, 0) END, 6) + 0 AS value
FROM signals LEFT JOIN sub USING (recording_id, channel, sample_idx)""")
def art15(spark, sf):
    out = art.subtract_template(fx.signals(spark, sf), peaks(spark, sf), 8, 8, ["signup"])
    return rounded(out, "value").select(*SERIES, "sample_idx", "value")


@query("agg11_gram", "WITH " + fx.FRAMES + """
SELECT a.recording_id, a.channel_idx AS i, b.channel_idx AS j, round(sum(a.value * b.value), 6) + 0 AS value
FROM wide a JOIN wide b ON a.recording_id = b.recording_id AND a.sample_idx = b.sample_idx GROUP BY ALL""")
def agg11(spark, sf):
    return rounded(ica.gram(fx.frames(spark, sf), 64), "value")


def _model(spark, sf):
    return ica.ica_fit(fx.frames(spark, sf), 64)


@query("art16_ica_fit")
def art16(spark, sf):
    m = _model(spark, sf)
    rows = [(i, j, float(v)) for i, w in enumerate(m.unmixing) for j, v in enumerate(w)]
    return spark.createDataFrame(rows, "component bigint, channel_idx bigint, weight double")


def component_labels(spark, sf):
    """Component labels: one row per part, its class from the brand and its probability from the price."""
    p = fx.table(spark, sf, "part")
    kinds = ["brain", "eye blink", "muscle artifact", "heart beat", "line noise", "channel noise", "other"]
    return p.select(
        F.col("p_partkey").alias("component"), F.array(*[F.lit(k) for k in kinds])[(F.col("p_size") % 7).cast("int")].alias("label"),
        ((F.col("p_partkey") * 37 % 101) / 100.0).alias("proba"))


_LAB = """WITH l AS (SELECT p_partkey AS component, ['brain', 'eye blink', 'muscle artifact', 'heart beat', 'line noise', 'channel noise', 'other'][p_size % 7 + 1] AS label,
  (p_partkey * 37 % 101) / 100.0::DOUBLE AS proba FROM part) SELECT component, label FROM l WHERE """


@query("art17_select_components", _LAB + "label NOT IN ('brain', 'other') AND proba > 0.5")
def art17(spark, sf):
    return ica.select_components(component_labels(spark, sf)).select("component", "label")


@query("art17_select_components_non_brain", _LAB + "label <> 'brain' AND proba > 0.7")
def art17b(spark, sf):
    return ica.select_components(component_labels(spark, sf), "non_brain").select("component", "label")


@query("art17_select_components_non_brain_60", _LAB + "label <> 'brain' AND proba > 0.6")
def art17c(spark, sf):
    return ica.select_components(component_labels(spark, sf), "non_brain_60").select("component", "label")


def _segment_frames(spark, sf):
    """The event recordings as frames, cut into three segments each."""
    from ..plans.blocks import to_frames

    frames = to_frames(rect(spark, sf), NAMES)
    last = frames.groupBy("recording_id").agg((F.max("sample_idx") + 1).alias("_n"))
    cut = spread_join(frames, last, ["recording_id"], "sample_idx")
    return cut.withColumn("segment_idx", F.floor(F.col("sample_idx") * 3 / F.col("_n")).cast("bigint")).drop("_n")


_SEGMENT = ["recording_id", "segment_idx"]


# What holds for every model: components of unit covariance, and a mixing matrix that undoes the unmixing. Whether a
# settled model is a fixed point is tested on planted sources.
@query("art16_ica_fit_segments", """
SELECT 'r' || r AS recording_id, segment_idx, CAST(5 AS INT) AS k, true AS white, true AS inverse
FROM (SELECT DISTINCT user_id % 4 AS r FROM events), (SELECT unnest(CAST([0, 1, 2] AS BIGINT[])) AS segment_idx)""")
def art16b(spark, sf):
    frames = _segment_frames(spark, sf)
    models = keyed_ica.ica_fit_keyed(frames, len(NAMES), _SEGMENT, variance=None)
    return keyed_ica.model_checks(frames, models, len(NAMES), _SEGMENT).drop("fixed")


@query("art18_ica_apply")
def art18(spark, sf):
    out = ica.ica_apply(fx.frames(spark, sf), _model(spark, sf), [0, 2])
    return out.select("recording_id", "sample_idx", F.posexplode("values").alias("channel_idx", "value"))


@query("art18_ica_apply_segments")
def art18b(spark, sf):
    frames = fx.frames(spark, sf)
    labels = frames.select("recording_id", F.floor(F.col("sample_idx") / 100).alias("segment_idx")).distinct().select(
        "*", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("component"))
    labels = labels.withColumn("label", F.when(F.col("component") == 0, "brain").otherwise("eye blink")).withColumn(
        "proba", F.when(F.col("segment_idx") % 2 == 0, 0.9).otherwise(0.4))
    out = ica.ica_apply(ica.segment_excludes(frames, labels, 1.0, 100.0), _model(spark, sf), "exclude")
    return out.select("recording_id", "sample_idx", F.posexplode("values").alias("channel_idx", "value"))
