"""Microstate queries on the embedding frames; maps are averages over the whole table."""

import numpy as np
from pyspark.sql import functions as F

from ..operators import microstates as ms
from ..operators import sequences as sq
from . import fixtures as fx
from .registry import query, r, rounded


def _average(df, keys):
    """Element-wise mean of ``values`` per key."""
    flat = df.select(*keys, F.posexplode("values").alias("i", "v")).groupBy(*keys, "i").agg(F.avg("v").alias("v"))
    return flat.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "v")))["v"].alias("values"))


def label_maps(spark, sf, k=4):
    """One map per embedding label modulo ``k``, unit norm."""
    e = fx.table(spark, sf, "embeddings").select((F.col("label") % k).cast("bigint").alias("map_id"), F.col("embedding").cast("array<double>").alias("values"))
    return ms.unit_norm(ms.maps_matrix(_average(e, ["map_id"])))


def maps_sql(k=4, name="maps"):
    return f"""
{name}_raw AS (SELECT label % {k} AS map_id, i AS channel_idx, avg(CAST(embedding[i + 1] AS DOUBLE)) AS w
  FROM embeddings, (SELECT unnest(range(64)) AS i) GROUP BY ALL),
{name} AS (SELECT map_id, channel_idx, w / sqrt(sum(w * w) OVER (PARTITION BY map_id)) AS w FROM {name}_raw)"""


_REF = fx.FRAMES + """,
ref AS (SELECT recording_id, sample_idx, channel_idx, value - avg(value) OVER (PARTITION BY recording_id, sample_idx) AS x FROM wide),
gfp AS (SELECT recording_id, sample_idx, stddev_pop(x) AS gfp FROM ref GROUP BY ALL),
peaks AS (SELECT recording_id, sample_idx, gfp FROM (SELECT *, lag(gfp) OVER w AS a, lead(gfp) OVER w AS b FROM gfp
  WINDOW w AS (PARTITION BY recording_id ORDER BY sample_idx)) WHERE gfp > a AND gfp > b)"""


def fit_sql(k=4):
    return _REF + "," + maps_sql(k) + """,
sd AS (SELECT map_id, stddev_pop(w) AS s FROM maps GROUP BY 1),
c AS (SELECT r.recording_id, r.sample_idx, m.map_id, sum(r.x * m.w) / (64 * any_value(g.gfp) * any_value(sd.s)) AS c,
    sum(r.x * m.w) AS dot, sum(r.x * r.x) AS pw
  FROM ref r JOIN maps m USING (channel_idx) JOIN gfp g USING (recording_id, sample_idx) JOIN sd USING (map_id) GROUP BY ALL),
fit AS (SELECT recording_id, sample_idx, CAST(map_id AS BIGINT) AS label, c, dot, pw FROM c
  QUALIFY row_number() OVER (PARTITION BY recording_id, sample_idx ORDER BY c * c DESC, map_id) = 1)"""


@query("sig11_gfp", "WITH " + fx.SIGNALS + """
SELECT recording_id, sample_idx, round(stddev_pop(value), 6) + 0 AS gfp FROM signals GROUP BY ALL""")
def sig11(spark, sf):
    return rounded(ms.gfp(fx.signals(spark, sf)), "gfp")


@query("sig11_gfp_frames", "WITH " + _REF + " SELECT recording_id, sample_idx, round(gfp, 6) + 0 AS gfp FROM gfp")
def sig11b(spark, sf):
    return rounded(ms.with_gfp(fx.frames(spark, sf)).select("recording_id", "sample_idx", "gfp"), "gfp")


@query("mst1_gfp_peaks", "WITH " + _REF + " SELECT recording_id, sample_idx, round(gfp, 6) + 0 AS gfp FROM peaks")
def mst1(spark, sf):
    return rounded(ms.gfp_peaks(fx.frames(spark, sf)).select("recording_id", "sample_idx", "gfp"), "gfp")


@query("mst2_assign_maps", "WITH " + fit_sql() + " SELECT recording_id, sample_idx, label, round(c, 6) + 0 AS corr FROM fit")
def mst2(spark, sf):
    out = ms.assign_maps(ms.with_gfp(fx.frames(spark, sf)), label_maps(spark, sf))
    return rounded(out.select("recording_id", "sample_idx", "label", "corr"), "corr")


@query("mst3_modified_kmeans")
def mst3(spark, sf):
    maps, cv = ms.kmeans_restarts(fx.frames(spark, sf), 4, seed=7)
    return _solution(spark, [(4, maps, cv)])


def _solution(spark, found):
    rows = [(int(k), j, [float(v) for v in m], float(cv)) for k, maps, cv in found for j, m in enumerate(maps)]
    return spark.createDataFrame(rows, "k bigint, map_id bigint, values array<double>, cv double").select(
        "k", "map_id", F.posexplode("values").alias("channel_idx", "weight"), "cv")


@query("mst4_cv_criterion", "WITH " + fit_sql() + """
SELECT recording_id, round((sum(pw) - sum(dot * dot)) / (count(*) * 63), 6) + 0 AS var,
  round((sum(pw) - sum(dot * dot)) / (count(*) * 63) * 63 * 63 / (59.0::DOUBLE * 59), 6) + 0 AS cv FROM fit GROUP BY 1""")
def mst4(spark, sf):
    return rounded(ms.cv_criterion(fx.frames(spark, sf), label_maps(spark, sf)), "var", "cv")


@query("mst5_select_k")
def mst5(spark, sf):
    found = ms.select_k(fx.frames(spark, sf), 8, seed=7)
    return _solution(spark, [(k, m, cv) for k, (m, cv) in found.items()])


@query("mst6_fit_back", "WITH " + fit_sql() + """
SELECT recording_id, sample_idx, label, round(abs(c), 6) + 0 AS corr FROM fit WHERE abs(c) > 0.2""")
def mst6(spark, sf):
    return rounded(ms.fit_back(fx.frames(spark, sf), label_maps(spark, sf), 0.2), "corr")


_PEAK_FIT = fit_sql() + """,
pf AS (SELECT recording_id, sample_idx, label, c, gfp FROM fit JOIN peaks USING (recording_id, sample_idx))"""


@query("mst7_fit_back_peaks", "WITH " + _PEAK_FIT + """,
nx AS (SELECT *, lead(sample_idx) OVER w AS p2, lead(label) OVER w AS l2 FROM pf WINDOW w AS (PARTITION BY recording_id ORDER BY sample_idx)),
e AS (SELECT recording_id, label, l2, (sample_idx + p2) // 2 AS mid, unnest(range(sample_idx, p2)) AS j FROM nx WHERE p2 IS NOT NULL)
SELECT recording_id, j AS sample_idx, CASE WHEN j < mid THEN label ELSE l2 END AS label FROM e""")
def mst7(spark, sf):
    return ms.fit_back_peaks(fx.frames(spark, sf), label_maps(spark, sf))


@query("mst8_gev", "WITH " + _PEAK_FIT + """,
t AS (SELECT recording_id, sum(gfp * gfp) AS total, sum(gfp * gfp * c * c) AS e FROM pf GROUP BY 1)
SELECT t.recording_id, CAST(k AS BIGINT) AS label, round(coalesce(sum(gfp * gfp * c * c), 0) / any_value(total), 6) + 0 AS gev,
  round(any_value(e) / any_value(total), 6) + 0 AS gev_total
FROM t CROSS JOIN (SELECT unnest(range(4)) AS k) LEFT JOIN pf ON pf.recording_id = t.recording_id AND pf.label = k GROUP BY t.recording_id, k""")
def mst8(spark, sf):
    return rounded(ms.gev(fx.frames(spark, sf), label_maps(spark, sf)), "gev", "gev_total")


def _wcss_sql():
    parts = []
    for k in (2, 3, 4, 5):
        parts.append(maps_sql(k, f"m{k}"))
    fits = " UNION ALL ".join(
        f"SELECT {k} AS k, map_id, channel_idx, w, stddev_pop(w) OVER (PARTITION BY map_id) AS s FROM m{k}" for k in (2, 3, 4, 5))
    return _REF + "," + ",".join(parts) + f""",
allm AS ({fits}),
cc AS (SELECT k, p.recording_id, p.sample_idx, map_id, sum(r.x * w) / (64 * any_value(p.gfp) * any_value(s)) AS c
  FROM peaks p JOIN ref r USING (recording_id, sample_idx) JOIN allm USING (channel_idx) GROUP BY ALL),
curve AS (SELECT k, recording_id, sum(1 - m) AS wcss FROM (SELECT k, recording_id, sample_idx, max(c * c) AS m FROM cc GROUP BY ALL) GROUP BY ALL)"""


def _curve(spark, sf):
    return ms.wcss(fx.frames(spark, sf), {k: label_maps(spark, sf, k) for k in (2, 3, 4, 5)})


@query("mst9_wcss", "WITH " + _wcss_sql() + " SELECT recording_id, CAST(k AS BIGINT) AS k, round(wcss, 5) + 0 AS wcss FROM curve")
def mst9w(spark, sf):
    return rounded(_curve(spark, sf), "wcss", digits=5)


@query("mst9_kl_criterion", "WITH " + _wcss_sql() + """
SELECT recording_id, CAST(k AS BIGINT) AS k, round(abs(b - 2 * wcss + a) / wcss, 6) + 0 AS kl
FROM (SELECT *, lag(wcss) OVER w AS a, lead(wcss) OVER w AS b FROM curve WINDOW w AS (PARTITION BY recording_id ORDER BY k)) WHERE a IS NOT NULL AND b IS NOT NULL""")
def mst9(spark, sf):
    return rounded(ms.kl_criterion(_curve(spark, sf)), "kl")


def run_maps(spark, sf):
    """Four maps per embedding label: averages by vector number modulo 4."""
    e = fx.table(spark, sf, "embeddings").select(
        F.col("label").cast("bigint").alias("run_id"), (F.col("vec_id") % 4).alias("map_id"), F.col("embedding").cast("array<double>").alias("values"))
    return _average(e, ["run_id", "map_id"])


def template(spark, sf):
    e = fx.table(spark, sf, "embeddings").select((F.col("vec_id") % 4).alias("map_id"), F.col("embedding").cast("array<double>").alias("values"))
    return ms.maps_matrix(_average(e, ["map_id"]))


def _match_sql(polarity: bool):
    score = "rr" if polarity else "abs(rr)"
    return f"""
e AS (SELECT label, vec_id % 4 AS q, i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(64)) AS i)),
a AS (SELECT CAST(label AS BIGINT) AS run_id, q AS map_id, i, avg(v) AS v FROM e GROUP BY ALL),
b AS (SELECT q AS target, i, avg(v) AS t FROM e GROUP BY ALL),
rm AS (SELECT run_id, map_id, target, corr(v, t) AS rr FROM a JOIN b USING (i) GROUP BY ALL),
n AS (SELECT unnest([0, 1, 2, 3]::BIGINT[]) AS z),
perms AS (SELECT row_number() OVER (ORDER BY p.z, q.z, r.z, s.z) AS pid, [p.z, q.z, r.z, s.z] AS perm FROM n p, n q, n r, n s
  WHERE p.z <> q.z AND p.z <> r.z AND p.z <> s.z AND q.z <> r.z AND q.z <> s.z AND r.z <> s.z),
flat AS (SELECT pid, CAST(target AS BIGINT) AS target, perm[target + 1] AS map_id FROM perms, (SELECT unnest(range(4)) AS target)),
sc AS (SELECT run_id, pid, sum({score}) / 4 AS similarity FROM flat JOIN rm USING (map_id, target) GROUP BY ALL),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY similarity DESC, pid) = 1),
matched AS (SELECT run_id, target, map_id, CAST(CASE WHEN rr < 0 THEN -1 ELSE 1 END AS BIGINT) AS sign, similarity
  FROM best JOIN flat USING (pid) JOIN rm USING (run_id, map_id, target))"""


@query("mst10_match_maps", "WITH " + _match_sql(False) + " SELECT run_id, target, map_id, sign, round(similarity, 6) + 0 AS similarity FROM matched")
def mst10(spark, sf):
    return rounded(ms.match_maps(run_maps(spark, sf), template(spark, sf)), "similarity")


@query("mst10_match_maps_polarity", "WITH " + _match_sql(True) + " SELECT run_id, target, map_id, sign, round(similarity, 6) + 0 AS similarity FROM matched")
def mst10b(spark, sf):
    return rounded(ms.match_maps(run_maps(spark, sf), template(spark, sf), True), "similarity")


@query("mst11_mean_maps")
def mst11(spark, sf):
    maps, sim, std = ms.mean_maps(run_maps(spark, sf), 4, seed=7)
    rows = [(j, [float(v) for v in m], sim, std) for j, m in enumerate(np.asarray(maps))]
    return spark.createDataFrame(rows, "map_id bigint, values array<double>, mean_similarity double, std_similarity double").select(
        "map_id", F.posexplode("values").alias("channel_idx", "weight"), "mean_similarity", "std_similarity")


def _flat(df):
    return rounded(df.select("run_id", "map_id", F.posexplode("values").alias("channel_idx", "weight")).withColumn(
        "channel_idx", F.col("channel_idx").cast("bigint")), "weight")


@query("mst12_reorder_maps", "WITH " + _match_sql(False) + """
SELECT run_id, target AS map_id, i AS channel_idx, round(v * sign, 6) + 0 AS weight FROM matched JOIN a USING (run_id, map_id)""")
def mst12(spark, sf):
    return _flat(ms.reorder_maps(run_maps(spark, sf), template(spark, sf)))


@query("mst12_reorder_maps_explicit", "WITH " + _match_sql(False) + """
SELECT run_id, CAST(t AS BIGINT) AS map_id, i AS channel_idx, round(v * s, 6) + 0 AS weight
FROM (VALUES (0, 2, -1), (1, 0, 1), (2, 3, 1), (3, 1, -1)) o(t, m, s) JOIN a ON a.map_id = o.m""")
def mst12b(spark, sf):
    return _flat(ms.reorder_maps(run_maps(spark, sf), order=[2, 0, 3, 1], sign=[-1, 1, 1, -1]))


def _runs_sql(keys: str, source: str, at: str) -> str:
    return f""",
g AS (SELECT *, {at} - row_number() OVER (PARTITION BY {keys}, label ORDER BY {at}) AS g FROM {source}),
rr AS (SELECT {keys}, label, count(*) AS len, max({at}) = max(max({at})) OVER (PARTITION BY {keys}) AS is_last FROM g GROUP BY {keys}, label, g),
st AS (SELECT DISTINCT {keys}, CAST(s AS BIGINT) AS label FROM rr, (SELECT unnest(range(5)) AS s))"""


def _win_sql(window, step):
    return fx.LABELS + f""",
nn AS (SELECT recording_id, count(*) AS n FROM seq GROUP BY 1),
kk AS (SELECT recording_id, unnest(range(0, (n - {window}) // {step} + 1)) AS win FROM nn WHERE n >= {window}),
wseq AS (SELECT s.recording_id, win, s.sample_idx - win * {step} AS o, s.label FROM seq s
  JOIN kk ON kk.recording_id = s.recording_id AND s.sample_idx >= win * {step} AND s.sample_idx < win * {step} + {window})"""


@query("mst13_duration", "WITH " + fx.LABELS + _runs_sql("recording_id", "seq", "sample_idx") + """
SELECT recording_id, label, round(coalesce(avg(len) FILTER (NOT is_last), 1), 6) + 0 AS duration FROM st LEFT JOIN rr USING (recording_id, label) GROUP BY ALL""")
def mst13(spark, sf):
    return rounded(sq.duration(fx.labels(spark, sf), 5), "duration")


@query("mst13_duration_windowed", "WITH " + _win_sql(200, 100) + _runs_sql("recording_id, win", "wseq", "o") + """
SELECT recording_id, win, label, round(coalesce(avg(len) FILTER (NOT is_last), 1), 6) + 0 AS duration FROM st LEFT JOIN rr USING (recording_id, win, label) GROUP BY ALL""")
def mst13b(spark, sf):
    return rounded(sq.duration(fx.labels(spark, sf), 5, 200, 100), "duration")


@query("mst14_occurrence_windowed", "WITH " + _win_sql(200, 100) + _runs_sql("recording_id, win", "wseq", "o") + """
SELECT recording_id, win, label, CAST(count(len) AS DOUBLE) AS occurrence FROM st LEFT JOIN rr USING (recording_id, win, label) GROUP BY ALL""")
def mst14(spark, sf):
    return sq.occurrence(fx.labels(spark, sf), 5, 200, 100)


@query("mst14_occurrence_blocks", "WITH " + _win_sql(7, 7) + _runs_sql("recording_id, win", "wseq", "o") + """,
nb AS (SELECT recording_id, win, label, count(*) AS n FROM rr WHERE NOT is_last GROUP BY ALL)
SELECT r.recording_id, r.label, round(avg(n), 6) + 0 AS occurrence FROM (SELECT DISTINCT recording_id, label FROM st) r LEFT JOIN nb USING (recording_id, label) GROUP BY ALL""")
def mst14b(spark, sf):
    return rounded(sq.occurrence(fx.labels(spark, sf), 5, 7), "occurrence")


@query("mst15_coverage", "WITH " + fx.LABELS + """
SELECT recording_id, CAST(s AS BIGINT) AS label, round(avg(CASE WHEN label = s THEN 1.0::DOUBLE ELSE 0.0 END), 6) + 0 AS coverage
FROM seq, (SELECT unnest(range(5)) AS s) GROUP BY recording_id, s""")
def mst15(spark, sf):
    return rounded(sq.coverage(fx.labels(spark, sf), 5), "coverage")


@query("mst15_coverage_windowed", "WITH " + _win_sql(200, 100) + """
SELECT recording_id, win, CAST(s AS BIGINT) AS label, round(avg(CASE WHEN label = s THEN 1.0::DOUBLE ELSE 0.0 END), 6) + 0 AS coverage
FROM wseq, (SELECT unnest(range(5)) AS s) GROUP BY recording_id, win, s""")
def mst15b(spark, sf):
    return rounded(sq.coverage(fx.labels(spark, sf), 5, 200, 100), "coverage")


@query("mst16_analyze")
def mst16(spark, sf):
    labels, maps, cv = ms.analyze(fx.frames(spark, sf), seed=7)
    return sq.lz_complexity(labels, 100, 50).withColumn("k", F.lit(len(maps))).withColumn("cv", r(F.lit(cv)))
