"""Sample-level queries."""

from pyspark.sql import functions as F

from ..operators import signals as sg
from ..sources import tables as tb
from . import fixtures as fx
from .fixtures import scratch
from .registry import query, rounded

SERIES = ["recording_id", "channel"]
W = "WITH " + fx.SIGNALS


@query("src5_read_signals", W + " SELECT recording_id, channel, sample_idx, value FROM signals")
def src5(spark, sf):
    path = scratch(spark, "signals")
    fx.signals(spark, sf).write.parquet(path)
    return tb.read_signals(spark, path)


@query("prj8_crop", W + """
SELECT recording_id, channel, sample_idx - 40 AS sample_idx, value FROM signals WHERE sample_idx >= 40 AND sample_idx < 168""")
def prj8(spark, sf):
    return sg.crop(fx.signals(spark, sf), 2.51, 10.55, 16.0)


@query("prj8_crop_margins", W + """
SELECT recording_id, channel, sample_idx - 5 AS sample_idx, value
FROM (SELECT *, count(*) OVER (PARTITION BY recording_id, channel) AS n FROM signals) WHERE sample_idx >= 5 AND sample_idx < n - 7""")
def prj8b(spark, sf):
    return sg.crop_margins(fx.signals(spark, sf), 5, 7)


_RECT = fx.SIGNALS + """,
rect AS (SELECT * FROM (SELECT *, min(n) OVER (PARTITION BY recording_id) AS short FROM
  (SELECT *, count(*) OVER (PARTITION BY recording_id, channel) AS n FROM signals)) WHERE sample_idx < short)"""
_IDX = "CASE channel WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"


def _indexed(spark, sf):
    code = F.create_map(*[x for k, v in fx.CODE.items() for x in (F.lit(k), F.lit(v))])
    s = sg.trim_to_shortest(fx.signals(spark, sf))
    return s.withColumn("channel_idx", code[F.col("channel")].cast("bigint"))


@query("prj9_fix_channel_count_pad", "WITH " + _RECT + f"""
SELECT recording_id, CAST({_IDX} AS BIGINT) AS channel_idx, sample_idx, value FROM rect
UNION ALL SELECT DISTINCT recording_id, c AS channel_idx, sample_idx, 0.0::DOUBLE FROM rect, (SELECT unnest([5, 6]::BIGINT[]) AS c)""")
def prj9(spark, sf):
    return sg.fix_channel_count(_indexed(spark, sf), 7)


@query("prj9_fix_channel_count_cut", "WITH " + _RECT + f"""
SELECT recording_id, CAST({_IDX} AS BIGINT) AS channel_idx, sample_idx, value FROM rect WHERE {_IDX} < 3""")
def prj9b(spark, sf):
    return sg.fix_channel_count(_indexed(spark, sf), 3)


@query("prj10_scale_units", W + """
SELECT recording_id, channel, sample_idx, round(CASE WHEN recording_id = 'r1' THEN value ELSE value * 1e6::DOUBLE END, 2) + 0 AS value FROM signals""")
def prj10(spark, sf):
    s = fx.signals(spark, sf).withColumn("source", F.when(F.col("recording_id") == "r1", "normalization_1").otherwise("seg_1"))
    return rounded(sg.scale_units(s).drop("source"), "value", digits=2)


@query("prj10_apply_gain", W + """,
g AS (SELECT recording_id, channel, CAST(min(sample_idx + length(channel) - 3) AS DOUBLE) AS gain FROM signals GROUP BY ALL)
SELECT recording_id, channel, sample_idx, round(CASE WHEN gain <> 1 THEN value / gain ELSE value END, 6) + 0 AS value
FROM signals JOIN g USING (recording_id, channel)""")
def prj10b(spark, sf):
    s = fx.signals(spark, sf)
    g = s.groupBy(*SERIES).agg((F.min("sample_idx") + F.length("channel") - 3).cast("double").alias("gain"))
    return rounded(sg.apply_gain(s, g), "value").select(*SERIES, "sample_idx", "value")


def _holes(spark, sf, above):
    return fx.signals(spark, sf).withColumn("value", F.when(F.col("value") > above, float("nan")).otherwise(F.col("value")))


@query("prj11_drop_nonfinite", W + " SELECT recording_id, channel, sample_idx, value FROM signals WHERE value <= 120")
def prj11(spark, sf):
    return sg.drop_nonfinite(_holes(spark, sf, 120))


@query("prj11_drop_nonfinite_series", W + """
SELECT recording_id, channel, sample_idx, value FROM signals
WHERE (recording_id, channel) NOT IN (SELECT recording_id, channel FROM signals WHERE value > 330)""")
def prj11b(spark, sf):
    return sg.drop_nonfinite_series(_holes(spark, sf, 330))


@query("prj15_thin", W + """
SELECT recording_id, channel, sample_idx, value
FROM (SELECT *, count(*) OVER (PARTITION BY recording_id, channel) AS n FROM signals)
WHERE sample_idx % CASE WHEN n > 200 THEN n // 100 ELSE 1 END = 0""")
def prj15(spark, sf):
    return sg.thin(fx.signals(spark, sf), 100, 200)


def _rings(spark, sf):
    """Neighbour lists of the event channels: the next two channels in name order, cyclic."""
    c = fx.signals(spark, sf).select(*SERIES).distinct()
    names = sorted(fx.CODE)
    nxt = F.create_map(*[x for i, n in enumerate(names) for x in (
        F.lit(n), F.array(F.lit(names[(i + 1) % 5]), F.lit(names[(i + 2) % 5])))])
    return c.select(*SERIES, F.posexplode(nxt[F.col("channel")]).alias("p", "neighbor")).select(
        *SERIES, (F.col("p") + 1).cast("bigint").alias("neighbor_rank"), "neighbor")


@query("jon11_gather_neighbors", W + f""",
names AS (SELECT *, {_IDX} AS i FROM signals)
SELECT a.recording_id, a.channel, a.sample_idx, a.value, b.value AS first_neighbor, c.value AS second_neighbor
FROM names a LEFT JOIN names b ON b.recording_id = a.recording_id AND b.sample_idx = a.sample_idx AND b.i = (a.i + 1) % 5
LEFT JOIN names c ON c.recording_id = a.recording_id AND c.sample_idx = a.sample_idx AND c.i = (a.i + 2) % 5""")
def jon11(spark, sf):
    out = sg.gather_neighbors(fx.signals(spark, sf), _rings(spark, sf))
    return out.select(*SERIES, "sample_idx", "value", F.col("neighbor_values")[0].alias("first_neighbor"),
                      F.col("neighbor_values")[1].alias("second_neighbor"))


def peaks(spark, sf):
    """Event samples: positions where the click channel exceeds 100."""
    return fx.signals(spark, sf).filter("channel = 'click' AND value > 100").select("recording_id", F.col("sample_idx").alias("peak_idx"))


PEAKS = fx.SIGNALS + """,
peaks AS (SELECT recording_id, sample_idx AS peak_idx FROM signals WHERE channel = 'click' AND value > 100),
sizes AS (SELECT recording_id, max(sample_idx) + 1 AS n FROM signals GROUP BY ALL),
win AS (SELECT s.recording_id, s.channel, s.sample_idx, s.value, p.peak_idx, s.sample_idx - p.peak_idx AS offs
  FROM peaks p JOIN sizes z USING (recording_id) JOIN signals s USING (recording_id)
  WHERE p.peak_idx >= 8 AND p.peak_idx + 8 <= z.n AND s.sample_idx >= p.peak_idx - 8 AND s.sample_idx < p.peak_idx + 8)"""


@query("jon12_window_around_events", "WITH " + PEAKS + """
SELECT recording_id, channel, sample_idx, peak_idx, offs AS "offset", value FROM win""")
def jon12(spark, sf):
    return sg.window_around_events(fx.signals(spark, sf), peaks(spark, sf), 8, 8)


@query("jon13_merge_channels", W + """,
n AS (SELECT recording_id, least(max(sample_idx) FILTER (channel IN ('click', 'view')), max(sample_idx) FILTER (channel NOT IN ('click', 'view'))) AS last
  FROM signals GROUP BY ALL)
SELECT recording_id, channel, sample_idx, value FROM signals JOIN n USING (recording_id) WHERE sample_idx <= last""")
def jon13(spark, sf):
    s = fx.signals(spark, sf)
    eeg = F.col("channel").isin("click", "view")
    return sg.merge_channels(s.filter(eeg), s.filter(~eeg))


@query("jon14_trim_to_shortest", "WITH " + _RECT + " SELECT recording_id, channel, sample_idx, value FROM rect")
def jon14(spark, sf):
    return sg.trim_to_shortest(fx.signals(spark, sf))


@query("snk3_write_blocks", W + """
SELECT recording_id, channel, sample_idx // 120 AS block_idx, min(sample_idx) AS start_sample, count(*) AS n,
       round(sum(CAST(CAST(value AS FLOAT) AS DOUBLE)), 4) + 0 AS total FROM signals GROUP BY ALL""")
def snk3(spark, sf):
    path = scratch(spark, "blocks")
    tb.write_blocks(sg.pack_blocks(fx.signals(spark, sf), 120), path)
    b = tb.read_blocks(spark, path)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rounded(b.select(*SERIES, "block_idx", "start_sample", F.size("samples").cast("bigint").alias("n"), total.alias("total")), "total", digits=4)


@query("snk3_unique_channel_names", """
SELECT p_brand AS recording_id, p_type AS channel, p_partkey AS channel_order,
  p_type || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '_' || (row_number() OVER w - 1) END AS stored_name
FROM part WINDOW w AS (PARTITION BY p_brand, p_type ORDER BY p_partkey)""")
def snk3b(spark, sf):
    p = fx.table(spark, sf, "part").select(
        F.col("p_brand").alias("recording_id"), F.col("p_type").alias("channel"), F.col("p_partkey").alias("channel_order"))
    return sg.unique_channel_names(p)


def _quant(lo, hi):
    return W + f""",
lim AS (SELECT recording_id, channel, {lo} AS lo, {hi} AS hi FROM signals GROUP BY ALL)
SELECT recording_id, channel, sample_idx,
  CAST(trunc(least(greatest((value - lo) / (hi - lo) * 65535.0::DOUBLE - 32768.0::DOUBLE, -32768.0::DOUBLE), 32767.0::DOUBLE)) AS BIGINT) AS digital
FROM signals JOIN lim USING (recording_id, channel)"""


@query("snk4_quantize_int16", _quant("min(value)", "max(value)"))
def snk4(spark, sf):
    return sg.quantize_int16(fx.signals(spark, sf)).select(*SERIES, "sample_idx", F.col("digital").cast("bigint").alias("digital"))


@query("snk4_quantize_int16_padded", _quant("least(min(value), -100.0::DOUBLE)", "greatest(max(value), 100.0::DOUBLE)"))
def snk4b(spark, sf):
    return sg.quantize_int16(fx.signals(spark, sf), "padded").select(*SERIES, "sample_idx", F.col("digital").cast("bigint").alias("digital"))
