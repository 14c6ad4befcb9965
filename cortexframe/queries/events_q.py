"""Annotation, segment and interval queries."""

from pyspark.sql import functions as F

from ..functions.channels import natural_key
from ..operators import events as ev
from ..sources import tables as tb
from . import fixtures as fx
from .fixtures import scratch
from .registry import query, rounded

A = "WITH " + fx.ANNOTATIONS
_COLS = ["recording_id", "event_id", "onset", "duration", "description"]


@query("src5_read_annotations", A + " SELECT recording_id, onset, duration, description FROM annotations")
def src5(spark, sf):
    path = scratch(spark, "annotations")
    fx.annotations(spark, sf).write.parquet(path)
    return tb.read_annotations(spark, path)


_IS_MARKER = r"""(regexp_matches(trim(description), '2001\b\D*(\d+)') OR trim(description) = '2001'
  OR regexp_matches(trim(description), '5000\b\D*(\d+)') OR regexp_matches(trim(description), '2001\s+\d+'))"""


@query("prj12_parse_markers", A + f"""
SELECT recording_id, event_id, onset, trim(description) AS sequence FROM annotations WHERE {_IS_MARKER}""")
def prj12(spark, sf):
    return ev.parse_markers(fx.annotations(spark, sf)).select("recording_id", "event_id", "onset", "sequence")


@query("prj13_file_prefix", r"""
WITH f AS (SELECT o_orderkey, 'data/run.' || o_orderstatus || '/' || o_orderpriority || CASE WHEN o_orderstatus = 'F' THEN '_' || o_orderkey ELSE '' END || '.bdf' AS path FROM orders)
SELECT o_orderkey, regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', ''), '_\d+$', '') AS prefix FROM f""")
def prj13(spark, sf):
    o = fx.table(spark, sf, "orders")
    tail = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("_"), F.col("o_orderkey").cast("string"))).otherwise("")
    path = F.concat(F.lit("data/run."), "o_orderstatus", F.lit("/"), "o_orderpriority", tail, F.lit(".bdf"))
    return o.select("o_orderkey", ev.file_prefix(path).alias("prefix"))


_PAIRS = fx.ANNOTATIONS + r""",
tag AS (SELECT recording_id, event_id, starts_with(description, 'Start of stimulation') AS is_start, onset, duration,
    CAST(regexp_extract(description, '\[(\d+),\s*(\d+)\]', 1) AS BIGINT) AS id_a, CAST(regexp_extract(description, '\[(\d+),\s*(\d+)\]', 2) AS BIGINT) AS id_b
  FROM annotations WHERE description LIKE 'Start of stimulation%' OR description LIKE 'End of stimulation%'),
pairs AS (SELECT * FROM (SELECT recording_id, id_a, id_b, arg_max(onset, event_id) FILTER (is_start) AS "start",
    arg_max(onset + duration, event_id) FILTER (NOT is_start) AS "end" FROM tag GROUP BY recording_id, id_a, id_b) WHERE "start" < "end")"""


def stim(spark, sf):
    return ev.pair_stim(fx.annotations(spark, sf), "event_id")


@query("jon1_pair_stim", "WITH " + _PAIRS + """
SELECT recording_id, id_a, id_b, round("start", 6) + 0 AS "start", round("end", 6) + 0 AS "end" FROM pairs""")
def jon1(spark, sf):
    return rounded(stim(spark, sf), "start", "end")


@query("jon2_pad_intervals", "WITH " + _PAIRS + """
SELECT recording_id, id_a, id_b, round(greatest(0, "start" - 2), 6) + 0 AS "start", round("end" + 2, 6) + 0 AS "end" FROM pairs""")
def jon2(spark, sf):
    return rounded(ev.pad_intervals(stim(spark, sf)), "start", "end")


@query("jon2_pad_intervals_short_long", "WITH " + fx.INTERVALS + """
SELECT recording_id, greatest(0, "start" - 2) + 0 AS "start", "end" + CASE WHEN "end" - "start" < 28 THEN 30 ELSE 2 END AS "end" FROM intervals""")
def jon2b(spark, sf):
    return ev.pad_intervals(fx.intervals(spark, sf), "short_long")


def short_intervals(spark, sf):
    """Stimulation-like intervals inside the signals: an order of a customer per recording."""
    o = fx.table(spark, sf, "orders")
    start = (F.col("o_orderkey") % 30011) / 10.0 + (F.col("o_custkey") % 7) / 100.0
    return o.select(
        F.concat(F.lit("r"), (F.col("o_custkey") % 4).cast("string")).alias("recording_id"), start.alias("start"),
        (start + F.col("o_totalprice") / 4000000.0).alias("end"))


SHORT = """short AS (
  SELECT 'r' || (o_custkey % 4) AS recording_id, (o_orderkey % 30011) / 10.0::DOUBLE + (o_custkey % 7) / 100.0::DOUBLE AS "start",
    (o_orderkey % 30011) / 10.0::DOUBLE + (o_custkey % 7) / 100.0::DOUBLE + o_totalprice / 4000000.0::DOUBLE AS "end"
  FROM orders)"""
_INSIDE = """EXISTS (SELECT 1 FROM short i WHERE i.recording_id = s.recording_id
  AND s.sample_idx >= trunc(i."start" * 16) AND s.sample_idx < trunc(i."end" * 16))"""


@query("jon3_mask_samples", "WITH " + fx.SIGNALS + "," + SHORT + f"""
SELECT recording_id, channel, sample_idx, value FROM signals s WHERE NOT {_INSIDE}""")
def jon3(spark, sf):
    return ev.mask_samples(fx.signals(spark, sf), short_intervals(spark, sf), 16.0)


@query("jon3_mask_samples_inside", "WITH " + fx.SIGNALS + "," + SHORT + f"""
SELECT recording_id, channel, sample_idx, value FROM signals s WHERE {_INSIDE}""")
def jon3b(spark, sf):
    return ev.mask_samples(fx.signals(spark, sf), short_intervals(spark, sf), 16.0, "inside")


@query("jon4_flag_epochs", "WITH " + fx.INTERVALS + """,
epochs AS (SELECT recording_id, unnest(range(CAST(floor(min("start") / 1.5::DOUBLE) AS BIGINT), CAST(floor(max("end") / 1.5::DOUBLE) AS BIGINT) + 1)) AS epoch_idx
  FROM intervals GROUP BY 1)
SELECT recording_id, epoch_idx, EXISTS (SELECT 1 FROM intervals i WHERE i.recording_id = p.recording_id
  AND epoch_idx * 1.5::DOUBLE < i."end" AND epoch_idx * 1.5::DOUBLE + (1.5::DOUBLE - 1.0::DOUBLE / 128) > i."start") AS is_stim FROM epochs p""")
def jon4(spark, sf):
    iv = fx.intervals(spark, sf)
    span = iv.groupBy("recording_id").agg(F.floor(F.min("start") / 1.5).alias("lo"), F.floor(F.max("end") / 1.5).alias("hi"))
    ep = span.select("recording_id", F.explode(F.sequence("lo", "hi")).alias("epoch_idx"))
    return ev.flag_epochs(ep, iv, 1.5, 128.0)


_SEGS = fx.ANNOTATIONS + f""",
marks AS (SELECT recording_id, onset, arg_min(trim(description), event_id) AS sequence FROM annotations WHERE {_IS_MARKER} GROUP BY 1, 2),
segs AS (SELECT recording_id, row_number() OVER w - 1 AS seg_idx, onset AS seg_start, lead(onset) OVER w AS seg_end,
    sequence AS start_seq, lead(sequence) OVER w AS end_seq FROM marks WINDOW w AS (PARTITION BY recording_id ORDER BY onset)),
segments AS (SELECT * FROM segs WHERE seg_end IS NOT NULL)"""


def marks(spark, sf):
    m = ev.parse_markers(fx.annotations(spark, sf))
    return m.groupBy("recording_id", "onset").agg(F.min_by("sequence", "event_id").alias("sequence"))


def segments(spark, sf):
    return ev.markers_to_segments(marks(spark, sf))


@query("win8_markers_to_segments", "WITH " + _SEGS + """
SELECT recording_id, seg_idx, seg_start, seg_end, start_seq, end_seq FROM segments""")
def win8(spark, sf):
    return segments(spark, sf)


_HITS = _SEGS + """,
hits AS (SELECT a.recording_id, s.seg_idx, s.seg_start, a.event_id, a.onset, a.description FROM annotations a
  JOIN segments s ON s.recording_id = a.recording_id AND a.onset BETWEEN s.seg_start AND s.seg_end)"""


@query("jon8_annotations_in_segment", "WITH " + _HITS + " SELECT recording_id, seg_idx, event_id, onset FROM hits")
def jon8(spark, sf):
    return ev.annotations_in_segment(fx.annotations(spark, sf), segments(spark, sf)).select("recording_id", "seg_idx", "event_id", "onset")


@query("win9_before_after_tasks", "WITH " + _HITS + """,
m AS (SELECT recording_id, seg_idx, seg_start, min(onset) FILTER (contains(description, 'Start of stimulation')) AS s,
  max(onset) FILTER (contains(description, 'End of stimulation') OR contains(description, '2000')) AS e FROM hits GROUP BY ALL)
SELECT recording_id, seg_idx, 'before' AS condition, round(seg_start + 1.5, 6) + 0 AS tmin, round(seg_start + 30, 6) + 0 AS tmax FROM m WHERE s IS NOT NULL
UNION ALL SELECT recording_id, seg_idx, 'after', round(e + 5, 6) + 0, round(e + 35, 6) + 0 FROM m WHERE e IS NOT NULL""")
def win9(spark, sf):
    out = ev.before_after_tasks(segments(spark, sf), fx.annotations(spark, sf), (1.5, 30.0), (5.0, 35.0))
    return rounded(out, "tmin", "tmax")


@query("win7_debounce_markers", "WITH RECURSIVE " + fx.ANNOTATIONS + f""",
m AS (SELECT recording_id, round(onset / 600, 3) AS onset, event_id, trim(description) AS sequence FROM annotations WHERE {_IS_MARKER}),
tot AS (SELECT recording_id, max(round(onset / 600, 3)) AS total FROM annotations GROUP BY 1),
once AS (SELECT recording_id, onset, arg_min(sequence, event_id) AS sequence, min(onset) OVER (PARTITION BY recording_id) AS first FROM m GROUP BY recording_id, onset),
allowed AS MATERIALIZED (SELECT recording_id, onset, sequence FROM once JOIN tot USING (recording_id) WHERE onset = first OR total - onset > 10),
nxt AS MATERIALIZED (SELECT a.recording_id, a.onset, min(b.onset) AS nx FROM allowed a JOIN allowed b ON a.recording_id = b.recording_id AND b.onset - a.onset > 3 GROUP BY ALL),
kept AS (SELECT recording_id, min(onset) AS onset FROM allowed GROUP BY 1 UNION ALL SELECT n.recording_id, n.nx FROM kept k JOIN nxt n ON n.recording_id = k.recording_id AND n.onset = k.onset)
SELECT recording_id, onset, sequence FROM allowed JOIN kept USING (recording_id, onset)""")
def win7(spark, sf):
    a = fx.annotations(spark, sf).withColumn("onset", F.round(F.col("onset") / 600, 3))  # denser in time, so that bursts occur
    total = a.groupBy("recording_id").agg(F.max("onset").alias("total"))
    return ev.debounce_markers(ev.parse_markers(a), total)


def design(spark, sf):
    """A stimulation session per customer: each order is one stimulation with its markers."""
    o = fx.table(spark, sf, "orders")
    from ..plans.chunks import sequence_index

    nth = sequence_index(o.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"], "k")
    base = (F.col("k") * 1200).cast("double")
    dur = F.col("o_totalprice") / 1000.0
    rows = F.array(
        F.struct((base + 0.25).alias("onset"), F.concat(F.lit("5000 "), F.col("k").cast("string")).alias("description")),
        F.struct((base + 400.5).alias("onset"), F.lit("Start of stimulation").alias("description")),
        F.struct((base + 400.5 + dur).alias("onset"), F.lit("End of stimulation").alias("description")),
        F.struct((base + 1100.75).alias("onset"), F.concat(F.lit("2001 "), F.col("k").cast("string")).alias("description")),
    )
    return nth.select(F.col("o_custkey").cast("string").alias("recording_id"), F.posexplode(rows).alias("p", "r"), "k").select(
        "recording_id", (F.col("k") * 4 + F.col("p")).alias("event_id"), "r.onset", "r.description")


@query("win10_six_block_design", """
WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS recording_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k,
    o_totalprice / 1000.0::DOUBLE AS dur, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
w AS (SELECT recording_id, any_value(n) AS n, max(dur) FILTER (k = 0) < 120 AS sham, max(400.5 + dur) FILTER (k = 0) AS e0,
    max(1600.5 + dur) FILTER (k = 1) AS e1, max(2800.5 + dur) FILTER (k = 2) AS e2 FROM o GROUP BY 1),
b AS (SELECT recording_id, sham, unnest([
    {'block': 'baseline1', 's': 100.5::DOUBLE, 'e': 340.5::DOUBLE},
    {'block': 'off1', 's': CASE WHEN sham THEN 860.75 ELSE e0 + 60 END, 'e': 1100.75::DOUBLE},
    {'block': 'baseline2', 's': 1100.75::DOUBLE, 'e': 1540.5::DOUBLE},
    {'block': 'off2', 's': CASE WHEN sham THEN 2060.75 ELSE e1 + 60 END, 'e': 2300.75::DOUBLE},
    {'block': 'baseline3', 's': 2300.75::DOUBLE, 'e': 2740.5::DOUBLE},
    {'block': 'off3', 's': CASE WHEN sham THEN 3260.75 ELSE e2 + 60 END, 'e': 3500.75::DOUBLE}]) AS x FROM w WHERE n >= 3)
SELECT recording_id, CASE WHEN sham THEN 'sham' ELSE 'active' END AS kind, x.block AS block,
  CAST(trunc(x.s) AS BIGINT) AS start_s, CAST(trunc(x.e) AS BIGINT) AS end_s FROM b""")
def win10(spark, sf):
    return ev.six_block_design(design(spark, sf))


def file_signals(spark, sf):
    """One file per user; the files of a recording follow each other."""
    from ..plans.chunks import sequence_index

    e = fx.table(spark, sf, "events").select(
        fx.recording().alias("recording_id"), F.concat(F.lit("file_"), F.col("user_id").cast("string"), F.lit(".bdf")).alias("file"),
        F.col("event_type").alias("channel"), "ts", "event_id", "value")
    return sequence_index(e, ["recording_id", "file", "channel"], ["ts", "event_id"], "sample_idx")


def file_table(s):
    return s.groupBy("recording_id", "file").agg((F.max("sample_idx") + 1).alias("n_samples")).withColumn(
        "natural", natural_key(F.col("file")))


_FILES = """fs AS (
  SELECT 'r' || (user_id % 4) AS recording_id, user_id, event_type AS channel, event_id, value,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS sample_idx FROM events),
sizes AS (SELECT recording_id, user_id, max(sample_idx) + 1 AS n FROM fs GROUP BY ALL),
offs AS (SELECT recording_id, user_id, n, coalesce(sum(n) OVER (PARTITION BY recording_id ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM sizes)"""


@query("win11_concat_recordings", "WITH " + _FILES + """
SELECT recording_id, channel, CAST(sample_idx + o AS BIGINT) AS sample_idx, value FROM fs JOIN offs USING (recording_id, user_id)""")
def win11(spark, sf):
    s = file_signals(spark, sf)
    none = s.select("recording_id", "file", F.lit(0.0).alias("onset")).limit(0)
    out, _ = ev.concat_recordings(s, none, file_table(s), 16.0)
    return out.select("recording_id", "channel", "sample_idx", "value")


@query("win11_concat_annotations", "WITH " + _FILES + """
SELECT recording_id, event_id, round(value + o / 16.0::DOUBLE, 6) + 0 AS onset FROM fs JOIN offs USING (recording_id, user_id)""")
def win11b(spark, sf):
    s = file_signals(spark, sf)
    a = s.select("recording_id", "file", "event_id", F.col("value").alias("onset"))
    _, out = ev.concat_recordings(s, a, file_table(s), 16.0)
    return rounded(out, "onset").select("recording_id", "event_id", "onset")


def notes(spark, sf):
    """Free-text annotations inside the signals."""
    text = F.when(F.col("event_type") == "purchase", "Recording ENDS").when(F.col("event_type") == "view", "EDGE Boundary").otherwise("note")
    return fx.table(spark, sf, "events").select(
        fx.recording().alias("recording_id"), "event_id", (F.col("value") / 10 + F.when(F.col("event_type") == "purchase", 8.0).otherwise(0.0)).alias("onset"),
        F.lit(0.5).alias("duration"), text.alias("description"))


NOTES = """notes AS (
  SELECT 'r' || (user_id % 4) AS recording_id, event_id, value / 10 + CASE event_type WHEN 'purchase' THEN 8.0::DOUBLE ELSE 0.0::DOUBLE END AS onset,
    0.5::DOUBLE AS duration, CASE event_type WHEN 'purchase' THEN 'Recording ENDS' WHEN 'view' THEN 'EDGE Boundary' ELSE 'note' END AS description FROM events)"""
_CUT = NOTES + "," + fx.SIGNALS + """,
firsts AS (SELECT recording_id, arg_min(onset + duration, (onset, event_id)) AS cut FROM notes WHERE contains(lower(description), 'recording ends') GROUP BY 1),
cuts AS (SELECT f.recording_id, cut FROM firsts f JOIN (SELECT recording_id, max(sample_idx) / 16.0::DOUBLE AS t FROM signals GROUP BY 1) USING (recording_id) WHERE cut < t - 0.1)"""


@query("win12_trim_at_end_marker", "WITH " + _CUT + """
SELECT s.recording_id, channel, sample_idx, value FROM signals s LEFT JOIN cuts c USING (recording_id) WHERE cut IS NULL OR sample_idx / 16.0::DOUBLE <= cut""")
def win12(spark, sf):
    return ev.trim_at_end_marker(fx.signals(spark, sf), notes(spark, sf), 16.0)[0]


@query("win12_trim_annotations", "WITH " + _CUT + """
SELECT n.recording_id, event_id, description FROM notes n LEFT JOIN cuts c USING (recording_id) WHERE cut IS NULL OR onset <= cut""")
def win12b(spark, sf):
    return ev.trim_at_end_marker(fx.signals(spark, sf), notes(spark, sf), 16.0)[1].select("recording_id", "event_id", "description")


@query("win13_drop_boundary", "WITH " + NOTES + """
SELECT recording_id, event_id, description FROM notes WHERE NOT contains(lower(description), 'boundary')""")
def win13(spark, sf):
    return ev.drop_boundary(notes(spark, sf)).select("recording_id", "event_id", "description")


_BAD = fx.SIGNALS + """,
ep AS (SELECT recording_id, sample_idx // 40 AS epoch_idx, max(value) AS m FROM signals GROUP BY ALL),
tot AS (SELECT recording_id, count(DISTINCT sample_idx) / 16.0::DOUBLE AS total FROM signals GROUP BY ALL),
bad AS (SELECT recording_id, epoch_idx, row_number() OVER (PARTITION BY recording_id ORDER BY epoch_idx) - 1 AS i FROM ep WHERE m > 150)"""


@query("win14_annotate_bad_epochs", "WITH " + _BAD + "," + NOTES + """
SELECT recording_id, epoch_idx * 2.5::DOUBLE AS onset, round(least(2.5::DOUBLE, total - epoch_idx * 2.5::DOUBLE), 6) + 0 AS duration, 'bad_epoch_' || i AS description
FROM bad JOIN tot USING (recording_id) WHERE least(2.5::DOUBLE, total - epoch_idx * 2.5::DOUBLE) > 0
UNION ALL SELECT recording_id, onset, round(duration, 6) + 0, description FROM notes""")
def win14(spark, sf):
    s = fx.signals(spark, sf)
    bad = s.groupBy("recording_id", F.floor(F.col("sample_idx") / 40).alias("epoch_idx")).agg(F.max("value").alias("m")).filter("m > 150")
    totals = s.groupBy("recording_id").agg(((F.max("sample_idx") + 1) / F.lit(16.0)).alias("total"))
    return rounded(ev.annotate_bad_epochs(bad, totals, 2.5, notes(spark, sf)), "duration")
