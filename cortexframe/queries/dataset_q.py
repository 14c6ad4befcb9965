"""Dataset assembly, mask, loss and classifier queries."""

from pyspark.sql import functions as F

from ..operators import classifier as cl
from ..operators import dataset as ds
from ..operators import metrics as mt
from . import fixtures as fx
from .registry import query, rounded

SIZES_SQL = "sizes AS (SELECT recording_id, max(sample_idx) + 1 AS n_samples FROM signals GROUP BY 1)"


def sizes(spark, sf):
    return fx.signals(spark, sf).groupBy("recording_id").agg((F.max("sample_idx") + 1).alias("n_samples"))


@query("jon5_label_epochs", "WITH " + fx.STAGES + "," + fx.SIGNALS + """,
ep AS (SELECT DISTINCT recording_id, sample_idx // 16 AS epoch_idx FROM signals)
SELECT recording_id, epoch_idx, sleep_stage FROM ep JOIN stages USING (recording_id, epoch_idx)""")
def jon5(spark, sf):
    ep = fx.signals(spark, sf).select("recording_id", F.floor(F.col("sample_idx") / 16).alias("epoch_idx")).distinct()
    return ds.label_epochs(ep, fx.stages(spark, sf))


@query("jon5_unlabelled_recordings", "WITH " + fx.STAGES + """
SELECT DISTINCT recording_id FROM seq WHERE recording_id NOT IN (SELECT recording_id FROM stages WHERE sleep_stage = 2 AND epoch_idx = 0)""")
def jon5b(spark, sf):
    return ds.unlabelled(fx.labels(spark, sf), fx.stages(spark, sf).filter("sleep_stage = 2 AND epoch_idx = 0"))


@query("dst1_build_chunk_index", "WITH " + fx.SIGNALS + "," + SIZES_SQL + """
SELECT recording_id, CAST(unnest(range(0, n_samples // 70 * 70, 70)) AS BIGINT) AS chunk_start FROM sizes WHERE recording_id <> 'r2'""")
def dst1(spark, sf):
    return ds.build_chunk_index(sizes(spark, sf), sizes(spark, sf).filter("recording_id <> 'r2'"), 70)


@query("dst2_build_epoch_index", "WITH " + fx.STAGES + "," + fx.SIGNALS + "," + SIZES_SQL + """
SELECT recording_id, epoch_idx * 15 AS start_sample, sleep_stage AS label FROM stages JOIN sizes USING (recording_id) WHERE epoch_idx < n_samples // 15""")
def dst2(spark, sf):
    return ds.build_epoch_index(sizes(spark, sf), fx.stages(spark, sf), 0.5)


def channel_map(spark, sf):
    m = F.create_map(*[x for k, v in {"click": "BAS", "error": "BAS", "purchase": "EKG", "signup": "EMG", "view": "EMG"}.items() for x in (F.lit(k), F.lit(v))])
    code = F.create_map(*[x for k, v in fx.CODE.items() for x in (F.lit(k), F.lit(v))])
    c = fx.signals(spark, sf).select("recording_id", "channel").distinct()
    c = c.select("recording_id", "channel", m[F.col("channel")].alias("modality"), code[F.col("channel")].cast("bigint").alias("channel_order"))
    return c.filter(~((F.col("recording_id") == "r1") & (F.col("modality") == "EKG")))


MODS = ["BAS", "EKG", "EMG"]
_TENSOR = fx.SIGNALS + """,
cm AS (SELECT DISTINCT recording_id, channel, CASE WHEN channel IN ('click', 'error') THEN 'BAS' WHEN channel = 'purchase' THEN 'EKG' ELSE 'EMG' END AS modality FROM signals),
ep AS (SELECT recording_id, sample_idx // 40 AS epoch_idx, modality, channel, sum(CAST(CAST(value AS FLOAT) AS DOUBLE)) AS total FROM signals JOIN cm USING (recording_id, channel)
  WHERE NOT (recording_id = 'r1' AND modality = 'EKG') GROUP BY ALL HAVING count(*) = 40),
te AS (SELECT recording_id, epoch_idx, count(*) FILTER (modality = 'BAS') AS n_bas, count(*) FILTER (modality = 'EKG') AS n_ekg, count(*) FILTER (modality = 'EMG') AS n_emg, sum(total) AS total FROM ep GROUP BY ALL)"""


def _total():
    each = [F.aggregate(F.flatten(m), F.lit(0.0), lambda a, x: a + x.cast("double")) for m in MODS]
    return (each[0] + each[1] + each[2]).alias("total")


@query("dst3_epoch_tensor", "WITH " + _TENSOR + " SELECT recording_id, epoch_idx, n_bas, n_ekg, n_emg, round(total, 3) + 0 AS total FROM te")
def dst3(spark, sf):
    t = ds.epoch_tensor(fx.signals(spark, sf), channel_map(spark, sf), MODS, 40)
    return rounded(t.select("recording_id", "epoch_idx", *[F.size(m).cast("bigint").alias(f"n_{m.lower()}") for m in MODS], _total()), "total", digits=3)


@query("dst4_pad_batch", "WITH " + _TENSOR + """,
b AS (SELECT *, (row_number() OVER (ORDER BY recording_id, epoch_idx) - 1) // 8 AS batch FROM te)
SELECT recording_id, epoch_idx, CAST(batch AS BIGINT) AS batch, max(n_bas) OVER w AS n_bas, max(n_ekg) OVER w AS n_ekg, max(n_emg) OVER w AS n_emg,
  max(n_bas) OVER w - n_bas + max(n_ekg) OVER w - n_ekg + max(n_emg) OVER w - n_emg AS padded, round(total, 3) + 0 AS total FROM b WINDOW w AS (PARTITION BY batch)""")
def dst4(spark, sf):
    t = ds.pad_batch(ds.epoch_tensor(fx.signals(spark, sf), channel_map(spark, sf), MODS, 40), MODS, 8)
    pads = [F.size(F.filter(f"{m}_mask", lambda x: x)) for m in MODS]
    return rounded(t.select("recording_id", "epoch_idx", "batch", *[F.size(m).cast("bigint").alias(f"n_{m.lower()}") for m in MODS],
                            (pads[0] + pads[1] + pads[2]).cast("bigint").alias("padded"), _total()), "total", digits=3)


@query("dst5_stage_encode", """
SELECT o_orderkey, CAST(CASE o_orderkey % 8 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 4 WHEN 6 THEN 4 END AS BIGINT) AS stage FROM orders""")
def dst5(spark, sf):
    name = F.array(*[F.lit(n) for n in ("Wake", "W", "N1", "N2", "N3", "REM", "R", "?")])[(F.col("o_orderkey") % 8).cast("int")]
    return fx.table(spark, sf, "orders").select("o_orderkey", ds.stage_encode(name).cast("bigint").alias("stage"))


@query("dst6_split_files", """
SELECT 'file_' || o_orderkey || '.edf' AS file_path, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= floor(count(*) OVER () * 0.8::DOUBLE) THEN 'pretrain' ELSE 'validation' END AS split FROM orders""")
def dst6(spark, sf):
    return ds.split_files(fx.files(spark, sf).select("file_path"))


@query("dst7_kfold", """
SELECT CAST(f AS BIGINT) AS fold, CASE WHEN f < 4 THEN n // 5 ELSE n - 4 * (n // 5) END AS n FROM (SELECT count(*) AS n FROM events), (SELECT unnest(range(5)) AS f)""")
def dst7(spark, sf):
    return ds.kfold(fx.labels(spark, sf).withColumnRenamed("sample_idx", "epoch_idx"), 5).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("dst7_kfold_by_recording", """
WITH r AS (SELECT count(DISTINCT o_custkey) AS n FROM orders)
SELECT CAST(f AS BIGINT) AS fold, CASE WHEN f < 4 THEN n // 5 ELSE n - 4 * (n // 5) END AS recordings, 1::BIGINT AS folds_per_recording
FROM r, (SELECT unnest(range(5)) AS f)""")
def dst7b(spark, sf):
    s = fx.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("recording_id"), F.col("o_orderkey").alias("epoch_idx"))
    per = ds.kfold(s, 5, by="recording").groupBy("recording_id").agg(F.min("fold").alias("fold"), F.count_distinct("fold").alias("k"))
    return per.groupBy("fold").agg(F.count(F.lit(1)).alias("recordings"), F.max("k").alias("folds_per_recording"))


@query("dst8_limit_files", """
SELECT 'file_' || o_orderkey || '.edf' AS file_path FROM orders ORDER BY o_orderkey LIMIT 25""")
def dst8(spark, sf):
    return ds.limit_files(fx.files(spark, sf).select("file_path"), 25)


@query("dst8_shuffle_index", "WITH " + fx.STAGES + " SELECT count(*) AS n, count(*) AS distinct_positions, max(n) - 1 AS last FROM (SELECT count(*) OVER () AS n FROM stages)")
def dst8b(spark, sf):
    s = ds.shuffle_index(fx.stages(spark, sf), 42, ["recording_id", "epoch_idx"])
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("position").alias("distinct_positions"), F.max("position").alias("last"))


@query("dst9_patchify", """
SELECT vec_id, CAST(p AS BIGINT) AS patch_idx, 10::BIGINT AS n, round(list_sum([CAST(x AS DOUBLE) for x in embedding[p * 10 + 1:p * 10 + 10]]), 6) + 0 AS total
FROM embeddings, (SELECT unnest(range(6)) AS p)""")
def dst9(spark, sf):
    e = fx.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"))
    p = ds.patchify(e, 10)
    return rounded(p.select("vec_id", F.col("patch_idx").cast("bigint").alias("patch_idx"), F.size("patch").cast("bigint").alias("n"),
                            F.aggregate("patch", F.lit(0.0), lambda a, x: a + x).alias("total")), "total")


@query("dst10_block_mask", """
SELECT doc_id AS sample_id, 60::BIGINT AS masked, 90::BIGINT AS n_context, 60::BIGINT AS n_target, true AS consistent FROM documents""")
def dst10(spark, sf):
    ids = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"))
    m = ds.block_mask(ids, 150, 0.4)
    ok = (F.size(F.array_intersect("context", "target")) == 0) & F.forall("target", lambda i: F.get("mask", i) == 0) & (
        F.size(F.array_distinct(F.concat("context", "target"))) == 150)
    return m.select("sample_id", F.size(F.filter("mask", lambda x: x == 0)).cast("bigint").alias("masked"), F.size("context").cast("bigint").alias("n_context"),
                    F.size("target").cast("bigint").alias("n_target"), ok.alias("consistent"))


@query("dst10_span_mask", "SELECT doc_id AS sample_id, true AS consistent, true AS in_bounds FROM documents")
def dst10b(spark, sf):
    ids = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"))
    m = ds.block_mask(ids, 150, 0.5, method="span")
    hit = F.size(F.filter("mask", lambda x: x == 0))
    ok = (F.size(F.array_intersect("context", "target")) == 0) & F.forall("target", lambda i: F.get("mask", i) == 0) & (
        F.size(F.array_distinct(F.concat("context", "target"))) == 150) & (hit == F.size("target"))
    return m.select("sample_id", ok.alias("consistent"), ((hit >= 2) & (hit <= 75 + 9)).alias("in_bounds"))


@query("dst11_masked_mean_pool", """
SELECT CAST(label AS BIGINT) AS label, CAST(i AS BIGINT) AS i, round(coalesce(sum(CASE WHEN embedding[1] < 0.15 THEN CAST(embedding[i + 1] AS DOUBLE) END), 0)
  / greatest(count(*) FILTER (embedding[1] < 0.15), 1), 6) + 0 AS value FROM embeddings, (SELECT unnest(range(64)) AS i) GROUP BY ALL""")
def dst11(spark, sf):
    e = fx.table(spark, sf, "embeddings").select(F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    return rounded(ds.masked_mean_pool(e.withColumn("is_padding", ~(F.col("vector")[0] < 0.15)), ["label"]), "value")


def _tokens(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 10).alias("sample_id"), (F.col("vec_id") % 10).alias("patch_idx"), F.col("embedding").cast("array<double>").alias("vector"))


def _masks(spark, sf):
    ids = _tokens(spark, sf).select("sample_id").distinct()
    mask = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when((i + F.col("sample_id")) % 3 == 0, 0).otherwise(1))
    context = F.reverse(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda i: (i + F.col("sample_id")) % 3 != 0))
    return ids.select("sample_id", mask.alias("mask"), context.alias("context"))


@query("dst12_gather_patches", """
SELECT vec_id // 10 AS sample_id, vec_id % 10 AS patch_idx, row_number() OVER (PARTITION BY vec_id // 10 ORDER BY vec_id DESC) - 1 AS position,
  round(CAST(embedding[1] AS DOUBLE), 6) + 0 AS head FROM embeddings WHERE (vec_id % 10 + vec_id // 10) % 3 <> 0""")
def dst12(spark, sf):
    m = _masks(spark, sf).withColumn("context", F.col("context").cast("array<bigint>"))
    out = ds.gather_patches(_tokens(spark, sf), m)
    return rounded(out.select("sample_id", "patch_idx", F.col("position").cast("bigint").alias("position"), F.col("vector")[0].alias("head")), "head")


@query("dst12_replace_masked", """
SELECT vec_id // 10 AS sample_id, vec_id % 10 AS patch_idx, CASE WHEN (vec_id % 10 + vec_id // 10) % 3 = 0 THEN -1.0::DOUBLE ELSE round(CAST(embedding[5] AS DOUBLE), 6) + 0 END AS fifth FROM embeddings""")
def dst12b(spark, sf):
    out = ds.replace_masked(_tokens(spark, sf), _masks(spark, sf), -1.0)
    return rounded(out.select("sample_id", "patch_idx", F.col("vector")[4].alias("fifth")), "fifth")


@query("dst13_convert_recordings")
def dst13(spark, sf):
    out = ds.convert_recordings(fx.signals(spark, sf), 16.0, 8.0, block_seconds=10.0)
    return out.select("recording_id", "channel", "block_idx", "start_sample", F.size("samples").alias("n"))


_P = "WITH " + fx.PAIRS + ", el AS (SELECT vec_id, unnest(pred) AS p, unnest(target) AS t FROM pairs) "


@query("met1_cosine_loss", _P + """
SELECT round(avg(1 - c), 6) + 0 AS loss FROM (SELECT vec_id, sum(p * t) / (greatest(sqrt(sum(p * p)), 1e-8::DOUBLE) * greatest(sqrt(sum(t * t)), 1e-8::DOUBLE)) AS c FROM el GROUP BY 1)""")
def met1(spark, sf):
    return rounded(mt.cosine_loss(fx.pairs(spark, sf)), "loss")


@query("met2_mse", _P + "SELECT round(avg((p - t) ** 2), 6) + 0 AS mse FROM el")
def met2(spark, sf):
    return rounded(mt.mse(fx.pairs(spark, sf)), "mse")


@query("met2_lp_loss", _P + "SELECT round(avg(abs(p - t) ** 1.5::DOUBLE / 1.5::DOUBLE), 6) + 0 AS loss FROM el")
def met2b(spark, sf):
    return rounded(mt.lp_loss(fx.pairs(spark, sf), 1.5), "loss")


@query("met3_masked_smooth_l1", _P + """
SELECT round(sum(CASE WHEN d < 0.2 THEN 0.5 * d * d / 0.2 ELSE d - 0.1 END * m) / (sum(m) + 1e-8::DOUBLE), 6) + 0 AS loss
FROM (SELECT abs(p - t) AS d, CASE WHEN t > 0 THEN 1 ELSE 0 END AS m FROM el)""")
def met3(spark, sf):
    p = fx.pairs(spark, sf).withColumn("mask", F.transform("target", lambda t: F.when(t > 0, 1).otherwise(0)))
    return rounded(mt.masked_smooth_l1(p, beta=0.2), "loss")


@query("met4_snr_db", _P + "SELECT round(10 * log10(avg(t * t) / (avg((p - t) ** 2) + 1e-8::DOUBLE)), 6) + 0 AS snr_db FROM el")
def met4(spark, sf):
    return rounded(mt.snr_db(fx.pairs(spark, sf)), "snr_db")


def _logits(spark, sf):
    return fx.table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("y_true"), F.col("embedding").alias("logits"))


@query("met5_decode", "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1::BIGINT AS y_pred FROM embeddings")
def met5(spark, sf):
    return mt.decode(_logits(spark, sf)).select("vec_id", "y_pred")


@query("met5_accuracy", """
SELECT count(*) FILTER (label = list_position(embedding, list_max(embedding)) - 1) AS correct, count(*) AS total,
  round(count(*) FILTER (label = list_position(embedding, list_max(embedding)) - 1) / count(*), 6) + 0 AS accuracy FROM embeddings""")
def met5b(spark, sf):
    return rounded(mt.accuracy(mt.decode(_logits(spark, sf))), "accuracy")


@query("cls1_stage_classifier_cv")
def cls1(spark, sf):
    feats = cl.band_features(fx.signals(spark, sf), 64.0, 16, 16)
    pred, _ = cl.stage_classifier_cv(feats, fx.stages(spark, sf), 5)
    return pred
