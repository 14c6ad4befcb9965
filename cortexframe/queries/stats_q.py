"""Before/after comparison queries."""

from pyspark.sql import functions as F

from ..operators import stats as st
from . import fixtures as fx
from .registry import query, rounded

W = "WITH " + fx.PSD
_ALIGN = W + """,
al AS (SELECT b.recording_id, b.segment_idx, b.channel, b.freq, b.power_db AS before_db, a.power_db AS after_db
  FROM psd b JOIN psd a ON a.recording_id = b.recording_id AND a.segment_idx = b.segment_idx AND a.channel = b.channel AND a.freq = b.freq
    AND b.condition = 'before' AND a.condition = 'after')"""


@query("jon10_align_before_after", _ALIGN + """
SELECT recording_id, segment_idx, channel, freq, round(before_db, 6) + 0 AS before_db, round(after_db, 6) + 0 AS after_db FROM al""")
def jon10(spark, sf):
    return rounded(st.align_before_after(fx.psd(spark, sf)), "before_db", "after_db")


def _pair_sql(one, two, shift):
    return W + f"""
SELECT a.recording_id, a.segment_idx, a.channel, a.freq, round(a.power_db, 6) + 0 AS first_db, round(b.power_db, 6) + 0 AS second_db,
  '{one}_vs_{two}' AS strategy
FROM psd a JOIN psd b ON a.recording_id = b.recording_id AND a.channel = b.channel AND a.freq = b.freq AND b.segment_idx = a.segment_idx + {shift}
WHERE a.condition = '{one}' AND b.condition = '{two}'"""


def _pairs(strategy, shift):
    return lambda spark, sf: rounded(st.pair_segments(fx.psd(spark, sf), shift, strategy), "first_db", "second_db")


query("jon9_pair_segments_before_after", _pair_sql("before", "after", 1))(_pairs("before_vs_after", 1))
query("jon9_pair_segments_before_before", _pair_sql("before", "before", 2))(_pairs("before_vs_before", 2))
query("jon9_pair_segments_after_after", _pair_sql("after", "after", 1))(_pairs("after_vs_after", 1))

_T = _ALIGN + """,
tt AS (SELECT recording_id, channel, freq, count(*) AS n, avg(after_db - before_db) / (stddev_samp(after_db - before_db) / sqrt(count(*))) AS t FROM al GROUP BY ALL)"""


@query("sta1_paired_t", _T + " SELECT recording_id, channel, freq, n, round(t, 6) + 0 AS t FROM tt")
def sta1(spark, sf):
    return rounded(st.paired_t(st.align_before_after(fx.psd(spark, sf))), "t")


# closed form of the t distribution for whole degrees of freedom: finite trigonometric series
_P = _T + """,
co AS (SELECT j, product(CASE WHEN j = 0 THEN 1.0::DOUBLE ELSE (2 * j - 1) / (2.0::DOUBLE * j) END) OVER w AS even_c,
    product(CASE WHEN j = 0 THEN 1.0::DOUBLE ELSE 2 * j / (2.0::DOUBLE * j + 1) END) OVER w AS odd_c
  FROM (SELECT unnest(range(2000)) AS j) WINDOW w AS (ORDER BY j ROWS UNBOUNDED PRECEDING)),
th AS (SELECT *, atan(abs(t) / sqrt(n - 1)) AS th FROM tt WHERE n >= 2),
ser AS (SELECT recording_id, channel, freq, any_value(n) AS n, any_value(t) AS t, any_value(th) AS th,
    sum(even_c * power(cos(th), 2 * j)) FILTER (j <= (n - 3) / 2) AS ev, sum(odd_c * power(cos(th), 2 * j)) FILTER (j <= (n - 4) / 2) AS od
  FROM th JOIN co ON j <= n GROUP BY recording_id, channel, freq),
pt AS (SELECT recording_id, channel, freq, n, t, 1 - CASE WHEN n % 2 = 1 THEN sin(th) * coalesce(ev, 0)
    ELSE 2 / pi() * (th + sin(th) * cos(th) * coalesce(od, 0)) END AS p FROM ser
  UNION ALL SELECT recording_id, channel, freq, n, t, 1.0::DOUBLE FROM tt WHERE n < 2)"""


@query("sta1_paired_ttest", _P + " SELECT recording_id, channel, freq, n, round(t, 6) + 0 AS t, round(p, 6) + 0 AS p FROM pt")
def sta1p(spark, sf):
    return rounded(st.paired_ttest(st.align_before_after(fx.psd(spark, sf))), "t", "p")


# a p-like value that SQL can form too: exp(-|t| * 3)
_FDR = _T + """,
pv AS (SELECT *, exp(-3 * abs(t)) AS p FROM tt),
rk AS (SELECT *, p * count(*) OVER (PARTITION BY recording_id, channel) / row_number() OVER (PARTITION BY recording_id, channel ORDER BY p) AS q,
    row_number() OVER (PARTITION BY recording_id, channel ORDER BY p) AS k FROM pv),
fd AS (SELECT recording_id, channel, freq, p, least(1, min(q) OVER (PARTITION BY recording_id, channel ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS p_adj FROM rk)"""


def _fdr(spark, sf):
    t = st.paired_t(st.align_before_after(fx.psd(spark, sf))).withColumn("p", F.exp(-3 * F.abs("t")))
    return st.fdr_bh(t).select("recording_id", "channel", "freq", "p", "p_adj", "reject")


@query("sta2_fdr_bh", _FDR + " SELECT recording_id, channel, freq, round(p, 6) + 0 AS p, round(p_adj, 6) + 0 AS p_adj, p_adj <= 0.05 AS reject FROM fd")
def sta2(spark, sf):
    return rounded(_fdr(spark, sf), "p", "p_adj")


@query("sta3_significant_bins", _FDR + """
SELECT recording_id, channel, freq, round(p_adj, 6) + 0 AS p_adj FROM fd WHERE p_adj <= 0.05 AND freq BETWEEN 0.5 AND 40""")
def sta3(spark, sf):
    return rounded(st.significant_bins(_fdr(spark, sf)).select("recording_id", "channel", "freq", "p_adj"), "p_adj")


# per condition the index list of successive picks
INDEX = [(1, 0, 1), (1, 1, 3), (1, 2, 2), (2, 0, 2), (2, 1, 1), (2, 2, 3), (3, 0, 3), (3, 1, 2), (3, 2, 1)]


@query("sta4_shuffle_conditions", f"""
WITH f AS (SELECT o_custkey AS folder, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders)
SELECT CAST(folder AS VARCHAR) AS folder, o_orderkey, pos, CAST(condition AS BIGINT) AS condition
FROM f JOIN (VALUES {", ".join(map(str, INDEX))}) x(condition, i, idx) ON pos = idx - 1 + i * 3""")
def sta4(spark, sf):
    files = fx.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("folder"), F.col("o_orderkey").alias("natural"))
    index = spark.createDataFrame(INDEX, "condition bigint, i bigint, idx bigint")
    return st.shuffle_conditions(files, index, 3).select("folder", F.col("natural").alias("o_orderkey"), "pos", "condition")


def _strategy(one, two, shift):
    return f"""SELECT '{one}_vs_{two}' AS strategy, a.recording_id, a.segment_idx, a.channel, a.freq, a.power_db AS x, b.power_db AS y
FROM psd a JOIN psd b ON a.recording_id = b.recording_id AND a.channel = b.channel AND a.freq = b.freq AND b.segment_idx = a.segment_idx + {shift}
WHERE a.condition = '{one}' AND b.condition = '{two}'"""


_REPORT = W + ", pr AS (" + " UNION ALL ".join(_strategy(a, b, 1) for a, b in (("before", "after"), ("before", "before"), ("after", "after"))) + """),
ls AS (SELECT strategy, recording_id, segment_idx, channel, list(x ORDER BY freq) AS x, list(y ORDER BY freq) AS y FROM pr GROUP BY ALL),
h AS (SELECT [[39, 8, -4, -4, 1, 4, -2], [8, 19, 16, 6, -4, -7, 4], [-4, 16, 19, 12, 2, -4, 1], [-4, 6, 12, 14, 12, 6, -4],
  [1, -4, 2, 12, 19, 16, -4], [4, -7, -4, 6, 16, 19, 8], [-2, 4, 1, -4, -4, 8, 39]] AS m),
q AS (SELECT ls.*, i, least(greatest(i - 3, 0), 2) AS s, m FROM ls, h, (SELECT unnest(range(9)) AS i))
SELECT strategy, recording_id, segment_idx, channel, CAST(i AS DOUBLE) AS freq,
  round(list_dot_product([c / 42.0::DOUBLE for c in m[i - s + 1]]::DOUBLE[], x[s + 1:s + 7]), 5) + 0 AS first_db,
  round(list_dot_product([c / 42.0::DOUBLE for c in m[i - s + 1]]::DOUBLE[], y[s + 1:s + 7]), 5) + 0 AS second_db FROM q"""


@query("sta5_before_after_report", _REPORT)
def sta5(spark, sf):
    rep = st.before_after_report(fx.psd(spark, sf), 1, channels=sorted(fx.CODE))
    return rounded(rep["pairwise"], "first_db", "second_db", digits=5)


@query("sta5_report_tests", _P + """,
rk AS (SELECT *, p * count(*) OVER (PARTITION BY recording_id, channel) / row_number() OVER (PARTITION BY recording_id, channel ORDER BY p) AS q,
    row_number() OVER (PARTITION BY recording_id, channel ORDER BY p) AS k FROM pt),
fd AS (SELECT *, least(1, min(q) OVER (PARTITION BY recording_id, channel ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS p_adj FROM rk)
SELECT recording_id, channel, freq, n, round(t, 6) + 0 AS t, round(p, 6) + 0 AS p, round(p_adj, 6) + 0 AS p_adj, p_adj <= 0.05 AS reject FROM fd""")
def sta5t(spark, sf):
    rep = st.before_after_report(fx.psd(spark, sf), 1, channels=sorted(fx.CODE))
    return rounded(rep["tests"], "t", "p", "p_adj")
