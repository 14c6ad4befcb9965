"""Window, run and smoothing queries."""

from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import windows as wn
from . import fixtures as fx
from .registry import query, rounded

SERIES = ["recording_id", "channel"]
W = "WITH " + fx.SIGNALS


@query("win1_fixed_epochs", W + """
SELECT recording_id, channel, sample_idx, sample_idx // 24 AS epoch_idx, sample_idx % 24 AS "offset", value
FROM (SELECT *, count(*) OVER (PARTITION BY recording_id, channel) AS n FROM signals) WHERE sample_idx < n // 24 * 24""")
def win1(spark, sf):
    return wn.fixed_epochs(fx.signals(spark, sf), 1.5, 16.0)


@query("win2_sliding_windows", "WITH " + fx.LABELS + """,
n AS (SELECT recording_id, count(*) AS n FROM seq GROUP BY 1),
k AS (SELECT recording_id, unnest(range(0, (n - 100) // 60 + 1)) AS win FROM n WHERE n >= 100)
SELECT s.recording_id, s.sample_idx, s.label, win, s.sample_idx - win * 60 AS "offset"
FROM seq s JOIN k ON k.recording_id = s.recording_id AND s.sample_idx >= win * 60 AND s.sample_idx < win * 60 + 100""")
def win2(spark, sf):
    return wn.sliding_windows(fx.labels(spark, sf), 100, 60, ["recording_id"])


def flat_sql(window: int, threshold: float) -> str:
    return fx.SIGNALS + f""",
w AS (SELECT recording_id, channel, sample_idx // {window} AS win, max(value) - min(value) < {threshold} AS flat FROM signals GROUP BY ALL HAVING count(*) = {window}),
g AS (SELECT *, win - row_number() OVER (PARTITION BY recording_id, channel, flat ORDER BY win) AS g FROM w),
runs AS (SELECT recording_id, channel, flat, g, count(*) AS len FROM g GROUP BY ALL),
flat AS (SELECT recording_id, channel, coalesce(max(len) FILTER (flat), 0) AS longest FROM runs GROUP BY ALL)"""


@query("win3_longest_flat_run", "WITH " + flat_sql(4, 60.0) + " SELECT recording_id, channel, longest FROM flat")
def win3(spark, sf):
    return wn.longest_flat_run(fx.signals(spark, sf), 4, 60.0)


_MERGED = fx.INTERVALS + """,
o AS (SELECT *, max("end") OVER (PARTITION BY recording_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM intervals),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS isl FROM o),
merged AS (SELECT recording_id, min("start") AS "start", max("end") AS "end" FROM i GROUP BY recording_id, isl)"""


@query("win4_merge_intervals", "WITH " + _MERGED + """
SELECT recording_id, greatest(0, "start" - 2) + 0 AS "start", "end" + 2 AS "end" FROM merged""")
def win4(spark, sf):
    return ev.merge_and_pad(fx.intervals(spark, sf))


def _vectors(spark, sf):
    lab = fx.labels(spark, sf).withColumn("s", F.explode(F.array(*[F.lit(i) for i in range(5)])))
    return lab.select("recording_id", F.col("s").cast("string").alias("stage"), "sample_idx", F.when(F.col("s") == F.col("label"), 1).otherwise(0).alias("bit"))


@query("win5_binary_to_annotations", "WITH " + fx.LABELS + """,
g AS (SELECT *, sample_idx - row_number() OVER (PARTITION BY recording_id, label ORDER BY sample_idx) AS g FROM seq)
SELECT recording_id, round(min(sample_idx) / 4.0::DOUBLE, 6) AS onset, round(count(*) / 4.0::DOUBLE, 6) AS duration, 'Sleep_' || label AS description
FROM g GROUP BY recording_id, label, g""")
def win5(spark, sf):
    return wn.binary_to_annotations(_vectors(spark, sf), 4.0)


@query("win6_local_maxima", W + """
SELECT recording_id, channel, sample_idx, value FROM signals
WINDOW w AS (PARTITION BY recording_id, channel ORDER BY sample_idx)
QUALIFY value > lag(value) OVER w AND value > lead(value) OVER w""")
def win6(spark, sf):
    return wn.local_maxima(fx.signals(spark, sf))


_REASM = W + """,
n AS (SELECT recording_id, channel, count(*) AS n FROM signals GROUP BY ALL)
SELECT recording_id, channel, i AS sample_idx, CASE WHEN i < n // 24 * 24 THEN coalesce(value, 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS value
FROM (SELECT recording_id, channel, n, unnest(range({total})) AS i FROM n)
LEFT JOIN signals s USING (recording_id, channel) WHERE s.sample_idx = i
UNION ALL SELECT recording_id, channel, i, 0.0::DOUBLE FROM (SELECT recording_id, channel, n, unnest(range({total})) AS i FROM n) WHERE i >= n"""


@query("win15_reassemble_pad", _REASM.format(total="n + 10"))
def win15(spark, sf):
    s = fx.signals(spark, sf)
    totals = s.groupBy(*SERIES).agg((F.max("sample_idx") + 11).alias("total"))
    return wn.reassemble(wn.fixed_epochs(s, 1.5, 16.0), 24, totals)


@query("win15_reassemble_cut", W + """
SELECT recording_id, channel, sample_idx, value FROM (SELECT *, count(*) OVER (PARTITION BY recording_id, channel) AS n FROM signals)
WHERE sample_idx < least(n // 2, n // 24 * 24)
UNION ALL SELECT recording_id, channel, i, 0.0::DOUBLE FROM (
  SELECT recording_id, channel, unnest(range(n // 24 * 24, n // 2)) AS i FROM (SELECT recording_id, channel, count(*) AS n FROM signals GROUP BY ALL) WHERE n >= 24)""")
def win15b(spark, sf):
    s = fx.signals(spark, sf)
    totals = s.groupBy(*SERIES).agg(F.floor((F.max("sample_idx") + 1) / 2).alias("total"))
    return wn.reassemble(wn.fixed_epochs(s, 1.5, 16.0), 24, totals)


@query("win16_savgol", "WITH " + fx.PSD + """,
p AS (SELECT recording_id, condition, segment_idx, channel, list(power_db ORDER BY freq) AS y FROM psd GROUP BY ALL),
h AS (SELECT [[39, 8, -4, -4, 1, 4, -2], [8, 19, 16, 6, -4, -7, 4], [-4, 16, 19, 12, 2, -4, 1], [-4, 6, 12, 14, 12, 6, -4],
  [1, -4, 2, 12, 19, 16, -4], [4, -7, -4, 6, 16, 19, 8], [-2, 4, 1, -4, -4, 8, 39]] AS m),
q AS (SELECT p.*, i, least(greatest(i - 3, 0), 2) AS s, m FROM p, h, (SELECT unnest(range(9)) AS i))
SELECT recording_id, condition, segment_idx, channel, CAST(i AS DOUBLE) AS freq,
  round(list_dot_product([x / 42.0::DOUBLE for x in m[i - s + 1]]::DOUBLE[], y[s + 1:s + 7]), 5) + 0 AS power_db FROM q""")
def win16(spark, sf):
    out = wn.savgol(fx.psd(spark, sf), ["recording_id", "condition", "segment_idx", "channel"])
    return rounded(out, "power_db", digits=5)
