"""Sequence complexity queries on the event label sequences."""

from pyspark.sql import functions as F

from ..operators import sequences as sq
from . import fixtures as fx
from .registry import query, rounded

W = "WITH " + fx.LABELS


@query("seq1_random_walk", W + """
SELECT recording_id, sample_idx, i || '_' || j AS subset, CASE WHEN label IN (i, j) THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS step
FROM seq, (VALUES (0, 1), (0, 2), (0, 3), (0, 4), (1, 2)) s(i, j)""")
def seq1(spark, sf):
    return sq.random_walk(fx.labels(spark, sf), 5, 2)


_DFA = W + """,
walk AS (SELECT recording_id, CAST(s AS VARCHAR) AS subset, sample_idx, CASE WHEN label = s THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS step
  FROM seq, (SELECT unnest(range(5)) AS s)),
cent AS (SELECT *, step - avg(step) OVER (PARTITION BY recording_id, subset) AS x, count(*) OVER (PARTITION BY recording_id, subset) AS n FROM walk),
prof AS (SELECT *, sum(x) OVER (PARTITION BY recording_id, subset ORDER BY sample_idx ROWS UNBOUNDED PRECEDING) AS y FROM cent),
sc AS (SELECT i AS scale_idx, CAST(floor(2 ** (3 + 0.25::DOUBLE * i)) AS BIGINT) AS scale FROM (SELECT unnest(range(20)) AS i)),
fit AS (SELECT recording_id, subset, scale_idx, scale, sample_idx // scale AS w, regr_syy(y, sample_idx % scale)
    - regr_sxy(y, sample_idx % scale) ** 2 / regr_sxx(y, sample_idx % scale) AS sse
  FROM prof, sc WHERE sample_idx // scale < n // scale GROUP BY ALL),
fl AS (SELECT recording_id, subset, scale_idx, scale, sqrt(avg(sse / scale)) AS fluctuation FROM fit GROUP BY ALL)"""


def _flu(spark, sf):
    return sq.dfa(sq.random_walk(fx.labels(spark, sf), 5, 1), sq.dfa_scales(3, 8))


@query("seq2_dfa_fluctuation", _DFA + """
SELECT recording_id, subset, scale_idx, scale, round(fluctuation, 6) + 0 AS fluctuation FROM fl""")
def seq2(spark, sf):
    return rounded(_flu(spark, sf), "fluctuation")


@query("seq2_dfa_slope", _DFA + """
SELECT recording_id, subset, round(regr_slope(log2(fluctuation), log2(CAST(scale AS DOUBLE))), 6) + 0 AS slope FROM fl GROUP BY ALL""")
def seq2b(spark, sf):
    return rounded(sq.dfa_slope(_flu(spark, sf)), "slope")


def _h(source: str, keys: str, name: str = "entropy") -> str:
    return (f"SELECT {keys}, round(-sum(p * log2(p)), 6) + 0 AS {name} FROM (SELECT {keys}, n / sum(n) OVER (PARTITION BY {keys}) AS p FROM {source}) GROUP BY {keys}")


@query("seq3_entropy", W + ", c AS (SELECT recording_id, label, count(*) AS n FROM seq GROUP BY ALL) " + _h("c", "recording_id"))
def seq3(spark, sf):
    return rounded(sq.entropy(fx.labels(spark, sf)), "entropy")


@query("seq4_joint_entropy", "WITH " + fx.PREDICTIONS + ", c AS (SELECT recording_id, y_true, y_pred, count(*) AS n FROM predictions GROUP BY ALL) " + _h("c", "recording_id"))
def seq4(spark, sf):
    return rounded(sq.joint_entropy(fx.predictions(spark, sf), x="y_true", y="y_pred"), "entropy")


def words_sql(ks, include_last=False) -> str:
    drop = "" if include_last else "AND sample_idx < n - k"
    top = max(ks)
    leads = ", ".join(f"lead(label, {i}) OVER w AS l{i}" for i in range(top))
    word = "CASE k " + " ".join(f"WHEN {k} THEN concat_ws('_', {', '.join(f'l{i}' for i in range(k))})" for k in ks) + " END"
    return f""",
ld AS (SELECT recording_id, sample_idx, count(*) OVER (PARTITION BY recording_id) AS n, {leads} FROM seq WINDOW w AS (PARTITION BY recording_id ORDER BY sample_idx)),
words AS (SELECT recording_id, k, {word} AS word, count(*) AS n FROM ld, (SELECT unnest({list(ks)}::BIGINT[]) AS k) WHERE sample_idx + k <= n {drop} GROUP BY ALL)"""


@query("seq4_word_entropy", W + words_sql([1, 2, 3]) + _h("words", "recording_id, k"))
def seq4b(spark, sf):
    return rounded(sq.word_entropy(fx.labels(spark, sf), [1, 2, 3]), "entropy")


@query("seq4_word_entropy_all", W + words_sql([2, 4], True) + _h("words", "recording_id, k"))
def seq4c(spark, sf):
    return rounded(sq.word_entropy(fx.labels(spark, sf), [2, 4], include_last=True), "entropy")


_MI = """,
pr AS (SELECT a.recording_id, lag, a.label AS x, b.label AS y FROM seq a, (SELECT unnest(range(6)) AS lag) l
  JOIN seq b ON b.recording_id = a.recording_id AND b.sample_idx = a.sample_idx + lag),
cx AS (SELECT recording_id, lag, x, count(*) AS n FROM pr GROUP BY ALL), cy AS (SELECT recording_id, lag, y, count(*) AS n FROM pr GROUP BY ALL),
cxy AS (SELECT recording_id, lag, x, y, count(*) AS n FROM pr GROUP BY ALL),
mi AS (SELECT recording_id, lag, hx + hy - hxy AS mi FROM
  (SELECT recording_id, lag, -sum(p * log2(p)) AS hx FROM (SELECT recording_id, lag, n / sum(n) OVER (PARTITION BY recording_id, lag) AS p FROM cx) GROUP BY ALL)
  JOIN (SELECT recording_id, lag, -sum(p * log2(p)) AS hy FROM (SELECT recording_id, lag, n / sum(n) OVER (PARTITION BY recording_id, lag) AS p FROM cy) GROUP BY ALL) USING (recording_id, lag)
  JOIN (SELECT recording_id, lag, -sum(p * log2(p)) AS hxy FROM (SELECT recording_id, lag, n / sum(n) OVER (PARTITION BY recording_id, lag) AS p FROM cxy) GROUP BY ALL) USING (recording_id, lag))"""


@query("seq5_mutual_information", W + _MI + " SELECT recording_id, CAST(lag AS BIGINT) AS lag, round(mi, 6) + 0 AS mi FROM mi")
def seq5(spark, sf):
    return rounded(sq.mutual_information(fx.labels(spark, sf), 6), "mi")


def _pmi(length: str, ks) -> str:
    return W + _MI + words_sql(ks) + f""",
h AS (SELECT recording_id, k, -sum(p * log2(p)) AS h FROM (SELECT recording_id, k, n / sum(n) OVER (PARTITION BY recording_id, k) AS p FROM words) GROUP BY ALL)
SELECT recording_id, CAST(lag AS BIGINT) AS lag, round(mi, 6) + 0 AS pmi FROM mi WHERE lag < 2
UNION ALL SELECT a.recording_id, l.lag, round(2 * a.h - b.h - c.h, 6) + 0 FROM (SELECT unnest(range(2, 4)) AS lag) l
  JOIN h a ON a.k = {length} JOIN h b ON b.recording_id = a.recording_id AND b.k = a.k - 1 JOIN h c ON c.recording_id = a.recording_id AND c.k = a.k + 1"""


@query("seq6_partial_mi", _pmi("l.lag", [1, 2, 3, 4]))
def seq6(spark, sf):
    return rounded(sq.partial_mutual_information(fx.labels(spark, sf), 4), "pmi")


@query("seq6_partial_mi_compat", _pmi("4", [3, 4, 5]))
def seq6b(spark, sf):
    return rounded(sq.partial_mutual_information(fx.labels(spark, sf), 4, compat=True), "pmi")


@query("seq7_entropy_rate_excess", W + words_sql([1, 2, 3, 4]) + """,
h AS (SELECT recording_id, k, -sum(p * log2(p)) AS h FROM (SELECT recording_id, k, n / sum(n) OVER (PARTITION BY recording_id, k) AS p FROM words) GROUP BY ALL)
SELECT recording_id, round(regr_slope(h, k), 6) + 0 AS entropy_rate, round(regr_intercept(h, k), 6) + 0 AS excess_entropy FROM h GROUP BY 1""")
def seq7(spark, sf):
    return rounded(sq.entropy_rate_excess(fx.labels(spark, sf), 4), "entropy_rate", "excess_entropy")


@query("seq8_lz_complexity")
def seq8(spark, sf):
    return sq.lz_complexity(fx.labels(spark, sf), 200, 100)


@query("seq8_lz_complexity_whole")
def seq8b(spark, sf):
    return sq.lz_complexity(fx.labels(spark, sf).select("recording_id", "sample_idx", F.col("label")))
