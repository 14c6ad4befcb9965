"""Spectrum queries."""

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import spectra as sp
from . import fixtures as fx
from .registry import query, r, rounded

SERIES = ["recording_id", "channel"]


def _dft(n: int, step: int, fs: float, window: str, where: str) -> str:
    """SQL for windowed one-sided power of every window of the signals table."""
    half = n // 2
    return fx.SIGNALS + f""",
n_of AS (SELECT recording_id, channel, count(*) AS n FROM signals GROUP BY ALL),
win AS (
  SELECT s.recording_id, s.channel, k, s.sample_idx - k * {step} AS i, s.value
  FROM signals s JOIN n_of USING (recording_id, channel), (SELECT unnest(range(5000)) AS k) w
  WHERE s.sample_idx >= k * {step} AND s.sample_idx < k * {step} + {n} AND k * {step} + {n} <= n_of.n),
centred AS (
  SELECT *, (value - avg(value) OVER (PARTITION BY recording_id, channel, k)) * ({window}) AS x FROM win),
wsum AS (SELECT sum(({window}) * ({window})) AS w2 FROM (SELECT unnest(range({n})) AS i)),
dft AS (
  SELECT recording_id, channel, k, f, sum(x * cos(2 * pi() * f * i / {n})) AS re, sum(x * sin(2 * pi() * f * i / {n})) AS im
  FROM centred, (SELECT unnest(range({half + 1})) AS f) fr WHERE {where} GROUP BY ALL),
power AS (
  SELECT recording_id, channel, k, f * {fs} / {n} AS freq,
    (re * re + im * im) / ({fs} * (SELECT w2 FROM wsum)) * CASE WHEN f IN (0, {half}) THEN 1 ELSE 2 END AS p FROM dft)"""


def _hann(n):
    return f"0.5 - 0.5 * cos(2 * pi() * i / {n})"


def _tukey(n):
    e = 0.125 * n
    return (f"CASE WHEN i <= floor({e}) THEN 0.5 * (1 - cos(pi() * i / {e})) "
            f"WHEN i >= {n} - floor({e}) THEN 0.5 * (1 - cos(pi() * ({n} - i) / {e})) ELSE 1.0 END")


@query("sig7_welch_psd", "WITH " + _dft(80, 40, 16.0, _hann(80), "f * 16.0 / 80 <= 40") + """
SELECT recording_id, channel, round(freq, 6) AS freq, round(10 * log10(avg(p)), 6) + 0 AS power_db
FROM power GROUP BY recording_id, channel, freq""")
def sig7(spark, sf):
    out = sp.welch_psd(fx.signals(spark, sf), fs=16.0, nperseg=80)
    return rounded(out, "freq", "power_db").select(*SERIES, "freq", "power_db")


@query("sig8_spectrogram", "WITH " + _dft(160, 80, 16.0, _tukey(160), "true") + """
SELECT recording_id, channel, (k * 80 + 80) / 16.0::DOUBLE AS time, round(freq, 6) AS freq,
       round(10 * log10(p), 4) + 0 AS power_db FROM power WHERE freq < 40""")
def sig8(spark, sf):
    out = sp.spectrogram(fx.signals(spark, sf), 16.0, 160, 80)
    return rounded(rounded(out, "freq"), "power_db", digits=4)


@query("sig8_spectrogram_emg", "WITH " + _dft(256, 128, 64.0, _hann(256), "f * 64.0 / 256 BETWEEN 15 AND 100") + """
SELECT recording_id, channel, (k * 128 + 128) / 64.0::DOUBLE AS time, round(freq, 6) AS freq,
       round(10 * log10(p), 4) + 0 AS power_db FROM power""")
def sig8_emg(spark, sf):
    out = sp.spectrogram(fx.signals(spark, sf), 64.0, 256, 128, "hann", 15.0, 100.0, include_fmax=True)
    return rounded(rounded(out, "freq"), "power_db", digits=4)


@query("sig9_band_power", "WITH " + fx.PSD + """,
banded AS (SELECT *, CASE WHEN freq >= 0.5 AND freq < 4 THEN 'delta' WHEN freq >= 4 AND freq < 8 THEN 'theta'
  WHEN freq >= 8 AND freq < 12 THEN 'alpha' WHEN freq >= 12 AND freq < 30 THEN 'beta'
  WHEN freq >= 30 AND freq <= 40 THEN 'gamma' END AS band FROM psd)
SELECT recording_id, condition, channel, band, round(avg(power_db), 6) + 0 AS power_db
FROM banded WHERE band IS NOT NULL GROUP BY ALL""")
def sig9(spark, sf):
    return rounded(sp.band_power(fx.psd(spark, sf), ["recording_id", "condition", "channel"]), "power_db")


@query("sig10_to_db", """
SELECT o_orderkey, CASE WHEN p = 0 THEN '-inf' ELSE CAST('db' AS VARCHAR) END AS kind,
  CASE WHEN p = 0 THEN 0.0::DOUBLE ELSE round(10 * log10(p), 6) + 0 END AS power_db
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0.0::DOUBLE ELSE o_totalprice END AS p FROM orders)""")
def sig10(spark, sf):
    o = fx.table(spark, sf, "orders").withColumn("p", F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(F.col("o_totalprice")))
    db = sp.to_db(F.col("p"))
    return o.select(
        "o_orderkey", F.when(db == float("-inf"), "-inf").otherwise("db").alias("kind"),
        F.when(db == float("-inf"), F.lit(0.0)).otherwise(r(db)).alias("power_db"),
    )


@query("agg5_mean_sem", "WITH " + fx.PSD + """
SELECT recording_id, condition, channel, freq, round(avg(power_db), 6) + 0 AS mean_db,
       round(stddev_pop(power_db) / sqrt(count(*)), 6) + 0 AS sem_db, count(*) AS n
FROM psd WHERE NOT isnan(power_db) GROUP BY ALL""")
def agg5(spark, sf):
    return rounded(agg.mean_sem(fx.psd(spark, sf), ["recording_id", "condition", "channel", "freq"]), "mean_db", "sem_db")
