"""Aggregate and score queries."""

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from . import fixtures as fx
from .registry import query, rounded

SERIES = ["recording_id", "channel"]


@query("agg1_registry_totals", "WITH " + fx.REGISTRY + """
SELECT CAST(sum(file_count) AS BIGINT) AS total_subjects, round(sum(total_recording_hours), 3) + 0 AS total_recording_hours
FROM registry""")
def agg1(spark, sf):
    return rounded(agg.registry_totals(fx.registry(spark, sf)), "total_recording_hours", digits=3)


@query("agg2_run_counters", "WITH " + fx.FILES + """
SELECT count(*) AS total_files, count(*) FILTER (process_status IN ('success', 'skipped')) AS processed_success,
  count(*) FILTER (process_status NOT IN ('success', 'skipped')) AS processed_failed,
  count(*) FILTER (copy_status = 'success') AS copy_success, count(*) FILTER (copy_status <> 'success') AS copy_failed,
  round(sum(recording_duration) FILTER (copy_status = 'success'), 2) + 0 AS total_recording_seconds,
  round(sum(recording_duration) FILTER (copy_status = 'success') / 3600, 2) + 0 AS total_recording_hours,
  round(100.0::DOUBLE * count(*) FILTER (process_status IN ('success', 'skipped')) / count(*), 2) + 0 AS success_rate
FROM files""")
def agg2(spark, sf):
    out = agg.run_counters(fx.files(spark, sf))
    return rounded(out, "total_recording_seconds", "total_recording_hours", "success_rate", digits=2)


@query("agg3_class_counts", "WITH " + fx.STAGES + """
SELECT CAST(c AS BIGINT) AS sleep_stage, count(s.sleep_stage) AS n
FROM (SELECT unnest(range(7)) AS c) LEFT JOIN stages s ON s.sleep_stage = c GROUP BY c""")
def agg3(spark, sf):
    return agg.class_counts(fx.stages(spark, sf), 7, "sleep_stage")


_WEIGHTS = """
counts AS (SELECT CAST(c AS BIGINT) AS sleep_stage, count(s.sleep_stage) AS n
  FROM (SELECT unnest(range(5)) AS c) LEFT JOIN stages s ON s.sleep_stage = c GROUP BY c)
SELECT sleep_stage, n, round({w} / sum({w}) OVER () * 5, 6) + 0 AS weight FROM counts"""


@query("agg4_class_weights", "WITH " + fx.STAGES + "," + _WEIGHTS.format(w="(1.0::DOUBLE / (n + 1e-6::DOUBLE))"))
def agg4(spark, sf):
    return rounded(agg.class_weights(fx.stages(spark, sf), 5, label="sleep_stage"), "weight")


@query("agg4_class_weights_sqrt", "WITH " + fx.STAGES + "," + _WEIGHTS.format(w="(1.0::DOUBLE / sqrt(n + 1e-6::DOUBLE))"))
def agg4s(spark, sf):
    return rounded(agg.class_weights(fx.stages(spark, sf), 5, "sqrt", "sleep_stage"), "weight")


_MEANS = fx.PSD + """,
means AS (SELECT recording_id, condition, channel, freq, avg(power_db) AS mean_db FROM psd GROUP BY ALL)"""


@query("agg6_value_range", "WITH " + _MEANS + """
SELECT channel, round(quantile_cont(mean_db, 0.01) - 5, 6) + 0 AS low, round(quantile_cont(mean_db, 0.99) + 5, 6) + 0 AS high
FROM means GROUP BY channel""")
def agg6(spark, sf):
    m = agg.mean_sem(fx.psd(spark, sf), ["recording_id", "condition", "channel", "freq"])
    return rounded(agg.value_range(m, ["channel"]), "low", "high")


@query("agg7_peak_to_peak", "WITH " + fx.SIGNALS + """
SELECT recording_id, channel, sample_idx // 16 AS win, round(max(value) - min(value), 6) + 0 AS p2p
FROM signals GROUP BY ALL HAVING count(*) = 16""")
def agg7(spark, sf):
    return rounded(agg.peak_to_peak(fx.signals(spark, sf), 16), "p2p")


@query("agg8_robust_z", "WITH " + fx.SIGNALS + """,
m AS (SELECT recording_id, channel, median(value) AS med FROM signals GROUP BY ALL),
d AS (SELECT recording_id, channel, median(abs(value - med)) AS mad FROM signals JOIN m USING (recording_id, channel) GROUP BY ALL)
SELECT recording_id, channel, sample_idx, round((value - med) / (mad / 0.6744897501960817::DOUBLE), 6) + 0 AS z
FROM signals JOIN m USING (recording_id, channel) JOIN d USING (recording_id, channel)""")
def agg8(spark, sf):
    out = agg.robust_z(fx.signals(spark, sf), SERIES, "value")
    return rounded(out, "z").select(*SERIES, "sample_idx", "z")


@query("agg9_stage_durations", "WITH " + fx.ANNOTATIONS + """
SELECT recording_id, description, round(sum(duration), 6) + 0 AS seconds
FROM (SELECT recording_id, duration, split_part(description, ' ', 1) AS description FROM annotations) GROUP BY ALL""")
def agg9(spark, sf):
    a = fx.annotations(spark, sf).withColumn("description", F.split("description", " ")[0])
    return rounded(agg.stage_durations(a), "seconds")


@query("agg10_bad_rate", "WITH " + fx.SIGNALS + """,
ep AS (SELECT recording_id, channel, sample_idx // 16 AS e, max(value) - min(value) AS p2p FROM signals GROUP BY ALL),
n AS (SELECT recording_id, count(DISTINCT e) AS n_epochs FROM ep GROUP BY ALL),
bad AS (SELECT recording_id, channel, count(*) AS n_bad FROM ep WHERE p2p > 150 GROUP BY ALL)
SELECT recording_id, channel, n_bad, n_epochs, round(n_bad / n_epochs, 6) + 0 AS rate
FROM bad JOIN n USING (recording_id) WHERE n_bad / n_epochs > 0.3""")
def agg10(spark, sf):
    s = fx.signals(spark, sf)
    ep = s.groupBy(*SERIES, F.floor(F.col("sample_idx") / 16).alias("epoch_idx")).agg(
        (F.max("value") - F.min("value")).alias("p2p"))
    n = ep.groupBy("recording_id").agg(F.count_distinct("epoch_idx").alias("n_epochs"))
    out = agg.bad_rate(ep.filter("p2p > 150"), n, 0.3)
    return rounded(out, "rate").select(*SERIES, "n_bad", "n_epochs", "rate")


def _confusion(k):
    return f""",
grid AS (SELECT CAST(a AS BIGINT) AS y_true, CAST(b AS BIGINT) AS y_pred
  FROM (SELECT unnest(range({k})) AS a), (SELECT unnest(range({k})) AS b)),
cm AS (SELECT g.y_true, g.y_pred, count(p.y_true) AS n FROM grid g
  LEFT JOIN predictions p ON p.y_true = g.y_true AND p.y_pred = g.y_pred GROUP BY ALL)"""


_CM = """
SELECT y_true, y_pred, n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY y_true), 0), 0), 6) + 0 AS recall FROM cm"""


@query("agg12_confusion", "WITH " + fx.PREDICTIONS + _confusion(5) + _CM)
def agg12(spark, sf):
    return rounded(agg.confusion(fx.predictions(spark, sf), 5), "recall")


@query("agg12_confusion_two_class", "WITH " + fx.PREDICTIONS2 + _confusion(2) + _CM)
def agg12b(spark, sf):
    return rounded(agg.confusion(fx.predictions2(spark, sf), 2), "recall")


_CLASS = """,
cls AS (
  SELECT l AS label, support, coalesce(hit / nullif(pred, 0), 0) AS prec, coalesce(hit / nullif(support, 0), 0) AS rec
  FROM (SELECT y_true AS l, CAST(sum(n) AS BIGINT) AS support, sum(n) FILTER (y_true = y_pred) AS hit FROM cm GROUP BY 1)
  JOIN (SELECT y_pred AS l, sum(n) AS pred FROM cm GROUP BY 1) USING (l)),
sc AS (SELECT *, coalesce(2 * prec * rec / nullif(prec + rec, 0), 0) AS f FROM cls)"""
_SCORES = """
SELECT round(sum(rec * support) / sum(support), 6) + 0 AS accuracy, round(avg(rec) FILTER (support > 0), 6) + 0 AS balanced_accuracy,
  round(avg(prec), 6) + 0 AS macro_precision, round(avg(rec), 6) + 0 AS macro_recall, round(avg(f), 6) + 0 AS macro_f1,
  round(sum(prec * support) / sum(support), 6) + 0 AS weighted_precision,
  round(sum(rec * support) / sum(support), 6) + 0 AS weighted_recall,
  round(sum(f * support) / sum(support), 6) + 0 AS weighted_f1, CAST(sum(support) AS BIGINT) AS support FROM sc"""
_SCORE_COLS = ["accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision",
               "weighted_recall", "weighted_f1"]


@query("agg13_scores", "WITH " + fx.PREDICTIONS + _confusion(5) + _CLASS + _SCORES)
def agg13(spark, sf):
    return rounded(agg.scores(fx.predictions(spark, sf), 5), *_SCORE_COLS)


@query("agg13_scores_two_class", "WITH " + fx.PREDICTIONS2 + _confusion(2) + _CLASS + _SCORES)
def agg13b(spark, sf):
    return rounded(agg.scores(fx.predictions2(spark, sf), 2), *_SCORE_COLS)


@query("agg13_class_scores", "WITH " + fx.PREDICTIONS + _confusion(5) + _CLASS + """
SELECT label, round(prec, 6) + 0 AS precision, round(rec, 6) + 0 AS recall, round(f, 6) + 0 AS f1, support FROM sc""")
def agg13c(spark, sf):
    return rounded(agg.class_scores(fx.predictions(spark, sf), 5), "precision", "recall", "f1")


@query("agg14_weighted_mean", """
SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) + 0 AS mean FROM lineitem GROUP BY ALL""")
def agg14(spark, sf):
    return rounded(agg.weighted_mean(fx.table(spark, sf, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity"), "mean")


@query("agg15_fold_summary", "WITH " + fx.PREDICTIONS + """,
folds AS (SELECT recording_id, avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0 END) AS accuracy FROM predictions GROUP BY ALL)
SELECT round(avg(accuracy), 6) + 0 AS mean, round(stddev_pop(accuracy), 6) + 0 AS std FROM folds""")
def agg15(spark, sf):
    folds = fx.predictions(spark, sf).groupBy("recording_id").agg(
        F.avg(F.when(F.col("y_true") == F.col("y_pred"), 1.0).otherwise(0.0)).alias("accuracy"))
    return rounded(agg.fold_summary(folds), "mean", "std")


@query("agg16_standardize", "WITH " + fx.SIGNALS + """
SELECT recording_id, channel, sample_idx, round((value - avg(value) OVER w) /
  CASE WHEN stddev_pop(value) OVER w = 0 THEN 1.0 ELSE stddev_pop(value) OVER w END, 6) + 0 AS value
FROM signals WINDOW w AS (PARTITION BY recording_id, channel)""")
def agg16(spark, sf):
    return rounded(agg.standardize(fx.signals(spark, sf)), "value").select(*SERIES, "sample_idx", "value")


@query("agg17_standardize_epochs", "WITH " + fx.SIGNALS + """
SELECT recording_id, channel, sample_idx, round((value - avg(value) OVER w) /
  (coalesce(stddev_samp(value) OVER w, 0) + 1e-8::DOUBLE), 6) + 0 AS value
FROM signals WINDOW w AS (PARTITION BY recording_id, channel, sample_idx // 30)""")
def agg17(spark, sf):
    return rounded(agg.standardize_epochs(fx.signals(spark, sf), 30), "value").select(*SERIES, "sample_idx", "value")


@query("agg18_best_by", """
SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def agg18(spark, sf):
    o = fx.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return agg.best_by(o, ["o_custkey"], "o_totalprice", "o_orderkey")
