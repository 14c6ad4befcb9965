"""Channel queries: names come from a literal list spread over the part table."""

from pyspark.sql import functions as F

from ..functions.channels import ECG_WORDS, EEG_JOINED, ELECTRODES, EMG_WORDS, EOG_WORDS
from ..operators import channels as ch
from . import fixtures as fx
from .registry import query, rounded

NAMES = [
    "EEG Fpz-Cz", "C3-M2", "EOG(L)", "EKG_L-Cz", "CHIN2-C", "SpO2-0", "EMG submental", "Fp1-REF", "HEOG", "ECG", "EMG",
    "Muscle-L", "F4", "XF3", "CZA1", "T3_A2", "Heart rate", "FP1F7", "LeftEye", "O2-A1", "Airflow", "eog-r", "1C4",
    "EMG ECG", "P7", "Pz-Q9", "Q1-O2", "Foo-Bar", "EEG Q2-T9x", "EOG_h", "Leg/2", "EEG C4-Q",
]
_LIST = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
_MONTAGE_NAMES = ["F4", "P7", "C3", "M2", "O2", "A1", "T3", "A2", "Pz", "Fp1", "EEG Fpz", "EEG C4"]


def channels(spark, sf):
    name = F.array(*[F.lit(n) for n in NAMES])[(F.col("p_partkey") % len(NAMES)).cast("int")]
    return fx.table(spark, sf, "part").select(
        F.col("p_brand").alias("recording_id"),
        F.when(F.col("p_size") % 3 == 1, F.concat(name, F.lit("-"), F.col("p_size").cast("string"))).otherwise(name).alias("channel"),
        F.col("p_partkey").alias("channel_order"), F.col("p_type"),
        F.when(F.col("p_size") % 6 == 0, 2).when(F.col("p_size") % 6 == 1, 202).when(F.col("p_size") % 6 == 2, 402)
        .when(F.col("p_size") % 6 == 3, 302).when(F.col("p_size") % 6 == 4, 3).otherwise(99).alias("kind"),
    )


CHANNELS = f"""channels AS (
  SELECT p_brand AS recording_id,
    {_LIST}[p_partkey % {len(NAMES)} + 1] || CASE WHEN p_size % 3 = 1 THEN '-' || p_size ELSE '' END AS channel,
    p_partkey AS channel_order, p_type,
    [2, 202, 402, 302, 3, 99][p_size % 6 + 1] AS kind
  FROM part)"""

_EL = "[" + ", ".join(f"'{e}'" for e in ELECTRODES) + "]"


def typed_sql(simple: bool = False) -> str:
    joined = "" if simple else f"OR regexp_matches(array_to_string(toks, ''), '{EEG_JOINED}')"
    return CHANNELS + f""",
parts AS (SELECT *, list_filter(regexp_split_to_array(upper(channel), '[^A-Z0-9]+'), lambda x: x <> '') AS toks FROM channels),
typed AS (SELECT * EXCLUDE (toks), CASE
  WHEN toks[1] IN ('ECG', 'EMG', 'EOG', 'EEG') THEN lower(toks[1])
  WHEN regexp_matches(upper(channel), '{"|".join(ECG_WORDS)}') THEN 'ecg'
  WHEN regexp_matches(upper(channel), '{"|".join(EMG_WORDS)}') THEN 'emg'
  WHEN regexp_matches(upper(channel), '{"|".join(EOG_WORDS)}') THEN 'eog'
  WHEN contains(upper(channel), 'EEG') OR list_has_any(toks, {_EL}) {joined} THEN 'eeg' ELSE 'misc' END AS ch_type
  FROM parts)"""


def typed(spark, sf):
    return ch.classify_channels(channels(spark, sf))


@query("prj1_classify_channels", "WITH " + typed_sql() + " SELECT recording_id, channel, channel_order, ch_type FROM typed")
def prj1(spark, sf):
    return typed(spark, sf).select("recording_id", "channel", "channel_order", "ch_type")


@query("prj2_classify_simple", "WITH " + typed_sql(True) + " SELECT recording_id, channel, channel_order, ch_type FROM typed")
def prj2(spark, sf):
    return ch.classify_channels(channels(spark, sf), "simple").select("recording_id", "channel", "channel_order", "ch_type")


@query("prj3_map_kind", "WITH " + CHANNELS + """
SELECT channel_order, CASE kind WHEN 2 THEN 'EEG' WHEN 202 THEN 'EOG' WHEN 402 THEN 'ECG' WHEN 302 THEN 'EMG' WHEN 3 THEN 'TRIG'
  ELSE 'MISC' END AS ch_type, CASE WHEN kind IN (2, 202, 402, 302) THEN 'microV' ELSE 'n/a' END AS units FROM channels""")
def prj3(spark, sf):
    return ch.map_kind(channels(spark, sf)).select("channel_order", "ch_type", "units")


def modalities(spark, sf):
    """brand is the modality, type the channel."""
    p = fx.table(spark, sf, "part")
    return p.groupBy(F.col("p_brand").alias("modality"), F.col("p_type").alias("channel")).agg(
        F.min("p_partkey").alias("modality_order"))


MODALITIES = """modalities AS (
  SELECT p_brand AS modality, p_type AS channel, min(p_partkey) AS modality_order FROM part GROUP BY ALL)"""


def part_channels(spark, sf):
    return fx.table(spark, sf, "part").select(
        F.col("p_size").cast("string").alias("recording_id"), F.col("p_type").alias("channel"), F.col("p_partkey").alias("channel_order"))


@query("prj4_assign_modality", "WITH " + MODALITIES + """
SELECT CAST(p_size AS VARCHAR) AS recording_id, p_type AS channel, p_partkey AS channel_order, m.modality
FROM part JOIN (SELECT channel, arg_min(modality, modality_order) AS modality FROM modalities GROUP BY 1) m ON m.channel = p_type""")
def prj4(spark, sf):
    return ch.assign_modality(part_channels(spark, sf), modalities(spark, sf))


@query("jon6_require_all_modalities", """
WITH a AS (SELECT p_brand || '/' || p_size AS s, p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'BAS' WHEN 'SMALL' THEN 'EKG' WHEN 'LARGE' THEN 'EMG' ELSE 'RESP' END AS modality
  FROM part)
SELECT s AS recording_id, p_partkey AS channel_order, modality FROM a
WHERE s IN (SELECT s FROM a WHERE modality IN ('BAS', 'EKG', 'EMG') GROUP BY s HAVING count(DISTINCT modality) = 3)""")
def jon6(spark, sf):
    c = fx.table(spark, sf, "part")  # brand and size as recording: some of them lack a modality
    m = F.when(F.col("p_type") == "ECONOMY", "BAS").when(F.col("p_type") == "SMALL", "EKG").when(
        F.col("p_type") == "LARGE", "EMG").otherwise("RESP")
    c = c.select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("recording_id"),
                 F.col("p_partkey").alias("channel_order"), m.alias("modality"))
    return ch.require_all_modalities(c, ["BAS", "EKG", "EMG"])


def montage(spark):
    rows = [(n, round(0.03 * i - 0.15, 6), round(0.02 * ((i * 7) % 11) - 0.1, 6), round(0.01 * ((i * 5) % 13), 6))
            for i, n in enumerate(_MONTAGE_NAMES)]
    return spark.createDataFrame(rows, "channel string, x double, y double, z double")


MONTAGE = "montage AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', {round(0.03 * i - 0.15, 6)}::DOUBLE, {round(0.02 * ((i * 7) % 11) - 0.1, 6)}::DOUBLE, {round(0.01 * ((i * 5) % 13), 6)}::DOUBLE)"
    for i, n in enumerate(_MONTAGE_NAMES)) + ") t(channel, x, y, z))"


def _flat(df):
    return rounded(df.select("recording_id", "channel", "channel_order",
                             *[F.col(f"pos.{c}").alias(c) for c in "xyz"]), "x", "y", "z")


def _positions_sql(axis_default: str, split: str, pair: str) -> str:
    cols = []
    for i, c in enumerate("xyz"):
        d = axis_default.format(*[str(v[i]) for v in ((0, .08, .05), (0, 0, .1), (0, -.08, .05), (-.07, 0, .05), (0, 0, .1))])
        cols.append(f"round(CASE WHEN ch_type = 'eeg' AND regexp_matches(t.channel, '{split}') THEN {pair.format(c=c, d=d)} "
                    f"ELSE m.{c} END, 6) + 0 AS {c}")
    return f"""
SELECT recording_id, t.channel, channel_order, {', '.join(cols)}
FROM (SELECT *, regexp_split_to_array(channel, '{split}') AS ends FROM typed) t LEFT JOIN montage m ON m.channel = t.channel
LEFT JOIN montage a ON a.channel = t.ends[1] LEFT JOIN montage b ON b.channel = t.ends[2]"""


_REGION = ("CASE WHEN contains(upper(t.channel), 'F') THEN {} WHEN contains(upper(t.channel), 'C') THEN {} "
           "WHEN contains(upper(t.channel), 'P') OR contains(upper(t.channel), 'O') THEN {} "
           "WHEN contains(upper(t.channel), 'T') THEN {} ELSE {} END")


@query("prj5_resolve_positions", "WITH " + typed_sql() + "," + MONTAGE + _positions_sql(
    _REGION, "[-_]", "CASE WHEN a.x IS NOT NULL AND b.x IS NOT NULL THEN (a.{c} + b.{c}) / 2 ELSE coalesce(a.{c}, b.{c}, {d}) END"))
def prj5(spark, sf):
    return _flat(ch.resolve_positions(typed(spark, sf), montage(spark)))


@query("prj6_resolve_positions_first", "WITH " + typed_sql() + "," + MONTAGE + _positions_sql(
    "CASE WHEN false THEN {} WHEN false THEN {} WHEN false THEN {} WHEN false THEN {} ELSE {} END", "-", "coalesce(a.{c}, {d})"))
def prj6(spark, sf):
    return _flat(ch.resolve_positions(typed(spark, sf), montage(spark), "first"))


@query("prj7_pick_types", "WITH " + typed_sql() + """
SELECT recording_id, channel, channel_order FROM typed WHERE ch_type IN ('eeg', 'eog')""")
def prj7(spark, sf):
    c = channels(spark, sf)
    return ch.pick(c, typed(spark, sf), types=["eeg", "eog"]).select("recording_id", "channel", "channel_order")


@query("prj7_drop_bads", "WITH " + fx.SIGNALS + """
SELECT recording_id, channel, sample_idx, value FROM signals
WHERE (recording_id, channel) NOT IN (SELECT recording_id, channel FROM signals WHERE value > 330)""")
def prj7b(spark, sf):
    s = fx.signals(spark, sf)
    return ch.drop_channels(s, s.filter("value > 330"))


@query("prj14_rename_type_by_pattern", "WITH " + CHANNELS + """
SELECT channel_order, channel, CASE WHEN channel = 'EMG' THEN 'emg' WHEN channel = 'ECG' THEN 'ecg'
  WHEN regexp_matches(channel, '(?i)^EOG[-_]?[A-Za-z0-9]*$') THEN 'eog' ELSE 'eeg' END AS ch_type FROM channels""")
def prj14(spark, sf):
    c = channels(spark, sf).withColumn("ch_type", F.lit("eeg"))
    return ch.rename_type_by_pattern(c).select("channel_order", "channel", "ch_type")


def _first(extra):
    picks = ", ".join(f"arg_min(channel, channel_order) FILTER (ch_type = '{t}') AS {t}_channel" for t in ("ecg", "emg", "eog"))
    return "WITH " + typed_sql() + f"""
SELECT recording_id, {picks}, count(*) FILTER (ch_type <> 'eeg' {extra}) AS n_non_eeg FROM typed GROUP BY recording_id"""


@query("prj16_first_of_type", _first("AND ch_type <> 'misc'"))
def prj16(spark, sf):
    return ch.first_of_type(typed(spark, sf))


@query("prj16_first_of_type_stim", _first(""))
def prj16b(spark, sf):
    return ch.first_of_type(typed(spark, sf), include_misc=True)


def supplier_positions(spark, sf):
    """One electrode layout per nation from supplier columns; some positions are unusable."""
    k, b = F.col("s_suppkey"), F.col("s_acctbal")
    usable = F.when(k % 11 == 0, F.lit(0.0)).otherwise(F.lit(1.0))
    return fx.table(spark, sf, "supplier").select(
        F.col("s_nationkey").cast("string").alias("recording_id"), F.col("s_name").alias("channel"),
        F.struct((b / 10000 * usable).alias("x"), ((k * 37 % 101) / 100.0 * usable).alias("y"),
                 ((k * 53 % 89) / 100.0 * usable).alias("z")).alias("pos"))


POSITIONS = """pos AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS recording_id, s_name AS channel,
    CASE WHEN s_suppkey % 11 = 0 THEN 0.0::DOUBLE ELSE s_acctbal / 10000 END AS x,
    CASE WHEN s_suppkey % 11 = 0 THEN 0.0::DOUBLE ELSE CAST(s_suppkey * 37 % 101 AS DOUBLE) / 100 END AS y,
    CASE WHEN s_suppkey % 11 = 0 THEN 0.0::DOUBLE ELSE CAST(s_suppkey * 53 % 89 AS DOUBLE) / 100 END AS z
  FROM supplier)"""


@query("jon7_nearest_channels", "WITH " + POSITIONS + """,
ok AS (SELECT * FROM pos WHERE sqrt(x * x + y * y + z * z) > 1e-6),
d AS (SELECT a.recording_id, a.channel, b.channel AS neighbor, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2) AS dist
  FROM ok a JOIN ok b ON a.recording_id = b.recording_id AND a.channel <> b.channel),
k AS (SELECT *, row_number() OVER (PARTITION BY recording_id, channel ORDER BY dist, neighbor) AS neighbor_rank FROM d)
SELECT recording_id, channel, neighbor_rank, neighbor, round(dist, 6) + 0 AS distance FROM k WHERE neighbor_rank <= 3""")
def jon7(spark, sf):
    return rounded(ch.nearest_channels(supplier_positions(spark, sf)), "distance")
