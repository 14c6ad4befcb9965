"""Biosignal tables derived from the driver's parquet tables, and the same derivations as SQL."""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.chunks import sequence_index
from ..plans.joins import spread_join
from ..plans.materialize import materialize, shared_dir

_MEMO: dict[tuple, DataFrame] = {}


def once(fn):
    """Build a derived table once per Spark application and input folder."""

    @wraps(fn)
    def wrapper(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf, fn.__module__, fn.__name__)
        if key not in _MEMO:
            _MEMO[key] = materialize(fn(spark, sf))
        return _MEMO[key]

    return wrapper


def forget() -> None:
    """Build the derived tables anew at their next use."""
    _MEMO.clear()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_dir(spark)}/cortexframe/{name}-{uuid.uuid4().hex}"


def recording() -> F.Column:
    return F.concat(F.lit("r"), (F.col("user_id") % 4).cast("string"))


@once
def signals(spark, sf):
    """one channel per event type, samples in time order."""
    ev = table(spark, sf, "events").select(
        recording().alias("recording_id"), F.col("event_type").alias("channel"), "ts", "event_id", "value"
    )
    indexed = sequence_index(ev, ["recording_id", "channel"], ["ts", "event_id"], "sample_idx")
    return indexed.select("recording_id", "channel", "sample_idx", "value")


SIGNALS = """signals AS (
  SELECT 'r' || (user_id % 4) AS recording_id, event_type AS channel,
         row_number() OVER (PARTITION BY user_id % 4, event_type ORDER BY ts, event_id) - 1 AS sample_idx, value
  FROM events)"""


def frames(spark, sf):
    """one scalp map per vector; channel = position in the vector."""
    return table(spark, sf, "embeddings").select(
        F.lit("e0").alias("recording_id"), F.col("vec_id").alias("sample_idx"),
        F.col("embedding").cast("array<double>").alias("values"),
    )


FRAMES = """frames AS (
  SELECT 'e0' AS recording_id, vec_id AS sample_idx, CAST(embedding AS DOUBLE[]) AS vals FROM embeddings),
wide AS (
  SELECT recording_id, sample_idx, i AS channel_idx, vals[i + 1] AS value
  FROM frames, (SELECT unnest(range(64)) AS i))"""


def _onset():
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")  # no time zone involved
    return micros.cast("double") / F.lit(1e6)


@once
def annotations(spark, sf):
    """stimulation markers and counters from the event stream, onsets in seconds from the first event."""
    ev = table(spark, sf, "events")
    t0 = table(spark, sf, "events").agg(F.min(_onset())).first()[0]
    nth = sequence_index(
        ev.select(recording().alias("recording_id"), "user_id", "event_type", "ts", "event_id", "value"),
        ["user_id", "event_type"], ["ts", "event_id"], "nth",
    )
    ident = F.concat(F.lit(" ["), F.col("user_id").cast("string"), F.lit(", "), (F.col("nth") + 1).cast("string"), F.lit("]"))
    text = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("Start of stimulation"), ident))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("End of stimulation"), ident))
        .when(F.col("event_type") == "error", F.concat(F.lit("2001 "), (F.col("nth") + 1).cast("string")))
        .when(F.col("event_type") == "view", F.concat(F.lit("5000 "), (F.col("nth") + 1).cast("string")))
        .otherwise(F.lit("rest"))
    )
    return nth.select(
        "recording_id", "event_id", F.round(_onset() - F.lit(t0), 3).alias("onset"),
        F.col("value").alias("duration"), text.alias("description"),
    )


ANNOTATIONS = """annotations AS (
  SELECT 'r' || (user_id % 4) AS recording_id, event_id,
    round(epoch_us(ts)::DOUBLE / 1e6::DOUBLE - (SELECT min(epoch_us(ts)::DOUBLE / 1e6::DOUBLE) FROM events), 3) AS onset,
    value AS duration,
    CASE event_type
      WHEN 'signup' THEN 'Start of stimulation [' || user_id || ', ' || nth || ']'
      WHEN 'purchase' THEN 'End of stimulation [' || user_id || ', ' || nth || ']'
      WHEN 'error' THEN '2001 ' || nth WHEN 'view' THEN '5000 ' || nth ELSE 'rest' END AS description
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth
        FROM events))"""


def intervals(spark, sf):
    """shipping windows per supplier, in days."""
    start = F.unix_date(F.to_date("l_shipdate")).cast("double")
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("recording_id"), start.alias("start"),
        (start + F.col("l_quantity")).alias("end"),
    )


INTERVALS = """intervals AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS recording_id,
         CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS "start",
         CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) + l_quantity AS "end"
  FROM lineitem)"""

CODE = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}


@once
def labels(spark, sf):
    """one label sequence per recording."""
    code = F.create_map(*[x for k, v in CODE.items() for x in (F.lit(k), F.lit(v))])
    ev = table(spark, sf, "events").select(
        recording().alias("recording_id"), code[F.col("event_type")].cast("bigint").alias("label"), "ts", "event_id"
    )
    return sequence_index(ev, ["recording_id"], ["ts", "event_id"], "sample_idx").select(
        "recording_id", "sample_idx", "label"
    )


LABELS = """seq AS (
  SELECT 'r' || (user_id % 4) AS recording_id,
    row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS sample_idx,
    CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END
      AS BIGINT) AS label
  FROM events)"""


@once
def predictions(spark, sf):
    """true label and the next label as the prediction."""
    lab = labels(spark, sf)
    nxt = lab.select("recording_id", (F.col("sample_idx") - 1).alias("sample_idx"), F.col("label").alias("y_pred"))
    return lab.join(nxt, ["recording_id", "sample_idx"]).select(
        "recording_id", F.col("sample_idx").alias("epoch_idx"), F.col("label").alias("y_true"), "y_pred"
    )


PREDICTIONS = LABELS + """,
predictions AS (
  SELECT a.recording_id, a.sample_idx AS epoch_idx, a.label AS y_true, b.label AS y_pred
  FROM seq a JOIN seq b ON a.recording_id = b.recording_id AND b.sample_idx = a.sample_idx + 1)"""


def predictions2(spark, sf):
    """two-class predictions."""
    return table(spark, sf, "labels").select(
        F.lit("d").alias("recording_id"), F.col("doc_id").alias("epoch_idx"),
        F.col("quality").cast("bigint").alias("y_true"), F.col("toxic").cast("bigint").alias("y_pred"),
    )


PREDICTIONS2 = """predictions AS (
  SELECT 'd' AS recording_id, doc_id AS epoch_idx, CAST(quality AS BIGINT) AS y_true, CAST(toxic AS BIGINT) AS y_pred
  FROM labels)"""


def stages(spark, sf):
    """F8: one stage per 30 labels."""
    epoch = F.floor(F.col("sample_idx") / 30).cast("bigint").alias("epoch_idx")
    return labels(spark, sf).groupBy("recording_id", epoch).agg(F.min_by("label", "sample_idx").alias("sleep_stage"))


STAGES = LABELS + """,
stages AS (
  SELECT recording_id, sample_idx // 30 AS epoch_idx, arg_min(label, sample_idx) AS sleep_stage FROM seq GROUP BY ALL)"""


def registry(spark, sf):
    """one dataset per nation."""
    return table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).groupBy(F.col("n_name").alias("name")).agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("s_acctbal").alias("total_recording_hours"),
        F.min("s_suppkey").alias("start_id"), F.max("s_suppkey").alias("end_id"),
    )


REGISTRY = """registry AS (
  SELECT n_name AS name, count(*) AS file_count, sum(s_acctbal) AS total_recording_hours,
         min(s_suppkey) AS start_id, max(s_suppkey) AS end_id
  FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name)"""

STATUS = {"F": "success", "O": "skipped"}


def files(spark, sf):
    """one processed file per order."""
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "skipped").otherwise("failed")
    copy = F.when(F.col("o_orderpriority").startswith("1"), "skipped").otherwise("success")
    return o.select(
        F.concat(F.lit("file_"), F.col("o_orderkey").cast("string"), F.lit(".edf")).alias("file_path"),
        F.col("o_orderkey").alias("idx"), status.alias("process_status"), copy.alias("copy_status"),
        F.col("o_totalprice").alias("recording_duration"),
        F.when(status == "failed", F.concat(F.lit("could not decode "), F.repeat(F.col("o_orderpriority"), 20))).alias("error"),
    )


FILES = """files AS (
  SELECT 'file_' || o_orderkey || '.edf' AS file_path, o_orderkey AS idx,
    CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'skipped' ELSE 'failed' END AS process_status,
    CASE WHEN starts_with(o_orderpriority, '1') THEN 'skipped' ELSE 'success' END AS copy_status,
    o_totalprice AS recording_duration,
    CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'could not decode ' || repeat(o_orderpriority, 20) END AS error
  FROM orders)"""


def pairs(spark, sf):
    """every vector with its successor."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("pred"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("pred").alias("target"))
    return e.join(nxt, "vec_id")


PAIRS = """pairs AS (
  SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS pred, CAST(b.embedding AS DOUBLE[]) AS target
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


@once
def psd(spark, sf):
    """before/after spectra: segment = block of 16 samples, condition by the half of the record."""
    from ..operators.spectra import segment_psd

    return segment_psd(split_halves(spark, sf), fs=16.0, nperseg=16)


def split_halves(spark, sf):
    """F1 cut into 16-sample segments; the first half of a channel is 'before', the second 'after'."""
    s = signals(spark, sf)
    n = s.groupBy("recording_id", "channel").agg(F.floor(F.count(F.lit(1)) / 32).alias("_half"))
    seg = F.floor(F.col("sample_idx") / 16)
    return spread_join(s, n, ["recording_id", "channel"], "sample_idx").filter(seg < F.col("_half") * 2).select(
        "recording_id", F.when(seg < F.col("_half"), "before").otherwise("after").alias("condition"),
        (seg % F.col("_half")).cast("bigint").alias("segment_idx"), "channel",
        (F.col("sample_idx") % 16).alias("sample_idx"), "value",
    )


HALVES = SIGNALS + """,
halves AS (
  SELECT recording_id, CASE WHEN seg < half THEN 'before' ELSE 'after' END AS condition,
         seg % half AS segment_idx, channel, sample_idx % 16 AS sample_idx, value
  FROM (SELECT s.*, sample_idx // 16 AS seg,
               (count(*) OVER (PARTITION BY recording_id, channel)) // 32 AS half FROM signals s)
  WHERE seg < half * 2)"""

PSD = HALVES + """,
centred AS (
  SELECT *, (value - avg(value) OVER (PARTITION BY recording_id, condition, segment_idx, channel))
            * (0.5 - 0.5 * cos(2 * pi() * sample_idx / 16)) AS x FROM halves),
dft AS (
  SELECT recording_id, condition, segment_idx, channel, f,
         sum(x * cos(2 * pi() * f * sample_idx / 16)) AS re, sum(x * sin(2 * pi() * f * sample_idx / 16)) AS im
  FROM centred, (SELECT unnest(range(9)) AS f) GROUP BY ALL),
psd AS (
  SELECT recording_id, condition, segment_idx, channel, CAST(f AS DOUBLE) AS freq,
         10 * log10((re * re + im * im) / (16.0 * 6.0) * CASE WHEN f IN (0, 8) THEN 1 ELSE 2 END) AS power_db
  FROM dft)"""
