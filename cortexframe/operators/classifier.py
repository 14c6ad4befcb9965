"""Cross-validated, class-weighted stage classifier on band powers (Spark ML)."""

from __future__ import annotations

import warnings

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import lookup_join
from ..plans.materialize import materialize
from .aggregates import class_weights, scores
from .dataset import kfold
from .spectra import BANDS, band_power, welch_psd


def band_features(signals: DataFrame, fs: float, epoch_samples: int, nperseg: int) -> DataFrame:
    """Mean band power over channels per epoch: ``recording_id, epoch_idx`` and one column per band."""
    keys = ["recording_id", "epoch_idx", "channel"]
    epochs = signals.withColumn("epoch_idx", F.floor(F.col("sample_idx") / epoch_samples).cast("bigint")).withColumn(
        "sample_idx", F.col("sample_idx") % epoch_samples)
    power = band_power(welch_psd(epochs, fs, nperseg, keys=keys), keys)
    names = [b[0] for b in BANDS]
    wide = [F.avg(F.when(F.col("band") == b, F.col("power_db"))).alias(b) for b in names]
    return power.groupBy("recording_id", "epoch_idx").agg(*wide)


def stage_classifier_cv(features: DataFrame, stages: DataFrame, classes: int = 5, folds: int = 5, seed: int = 42,
                        by: str = "epoch", model: str = "logistic", max_iter: int = 50) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions and their scores per fold.

    Every fold trains on the other folds with inverse-frequency class weights (logistic regression) or a small
    perceptron; band columns without any value are left out.
    """
    names = [c for c in features.columns if c not in ("recording_id", "epoch_idx")]
    data = features.join(stages, ["recording_id", "epoch_idx"]).withColumn("label", F.col("sleep_stage").cast("double"))
    have = data.agg(*[F.count(c).alias(c) for c in names]).first()
    names = [c for c in names if have[c]]
    data = materialize(kfold(data.na.fill(0.0, names), folds, seed, by))
    out = None
    for f in range(folds):
        train, test = data.filter(F.col("fold") != f), data.filter(F.col("fold") == f)
        w = class_weights(train.withColumn("label", F.col("label").cast("bigint")), classes).select(
            F.col("label").cast("double").alias("label"), "weight")
        train = lookup_join(train, w, ["label"])
        assembled = VectorAssembler(inputCols=names, outputCol="raw")
        scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(assembled.transform(train))
        prepared = scaler.transform(assembled.transform(train))
        if model == "logistic":
            est = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", maxIter=max_iter, family="multinomial")
        else:
            est = MultilayerPerceptronClassifier(featuresCol="x", labelCol="label", layers=[len(names), 16, classes], seed=seed, maxIter=max_iter)
        fitted = est.fit(prepared)
        if model == "logistic" and fitted.summary.totalIterations >= max_iter:
            warnings.warn(f"fold {f} ended at the limit of {max_iter} steps")
        pred = fitted.transform(scaler.transform(assembled.transform(test))).select(
            "recording_id", "epoch_idx", "fold", F.col("label").cast("bigint").alias("y_true"), F.col("prediction").cast("bigint").alias("y_pred"))
        out = pred if out is None else out.unionByName(pred)
    out = materialize(out)
    per_fold = None
    for f in range(folds):
        s = scores(out.filter(F.col("fold") == f), classes).withColumn("fold", F.lit(f).cast("bigint"))
        per_fold = s if per_fold is None else per_fold.unionByName(s)
    return out, per_fold
