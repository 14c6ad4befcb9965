"""Grouped statistics over samples, spectra, labels and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.chunks import SERIES
from ..plans.joins import spread_join
from ..plans.quantiles import exact_quantiles


def mean_sem(df: DataFrame, keys: list[str], value: str = "power_db") -> DataFrame:
    """Mean and standard error (population std over root n); NaN rows are removed."""
    ok = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    return ok.groupBy(*keys).agg(
        F.avg(value).alias("mean_db"),
        (F.stddev_pop(value) / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("sem_db"),
        F.count(F.lit(1)).alias("n"),
    )


def value_range(df: DataFrame, keys: list[str], value: str = "mean_db") -> DataFrame:
    """Axis range: first and last percentile of the finite values, widened by 5."""
    finite = df.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")))
    q = exact_quantiles(finite, keys, value, {"low": 0.01, "high": 0.99})
    return q.select(*keys, (F.col("low") - 5).alias("low"), (F.col("high") + 5).alias("high"))


def registry_totals(datasets: DataFrame) -> DataFrame:
    return datasets.agg(
        F.sum("file_count").alias("total_subjects"), F.sum("total_recording_hours").alias("total_recording_hours")
    )


def run_counters(log: DataFrame) -> DataFrame:
    """Outcome counters of an archive run; skipped counts as processed but not as copied."""
    copied = F.col("copy_status") == "success"
    done = F.col("process_status").isin("success", "skipped")
    seconds = F.coalesce(F.sum(F.when(copied, F.col("recording_duration"))), F.lit(0.0))
    return log.agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if(done).alias("processed_success"),
        F.count_if(~done).alias("processed_failed"), F.count_if(copied).alias("copy_success"),
        F.count_if(~copied).alias("copy_failed"), seconds.alias("total_recording_seconds"),
        (seconds / 3600).alias("total_recording_hours"),
        F.try_divide(F.count_if(done) * 100.0, F.count(F.lit(1))).alias("success_rate"),
    )


def class_counts(labels: DataFrame, k: int, label: str = "label") -> DataFrame:
    """Rows per class ``0..k-1``, zero for absent classes."""
    classes = labels.sparkSession.range(k).select(F.col("id").alias(label))
    seen = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return classes.join(seen, label, "left").select(label, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def class_weights(labels: DataFrame, k: int, mode: str = "inverse", label: str = "label") -> DataFrame:
    """``1/(n + 1e-6)`` or ``1/sqrt(n + 1e-6)``, scaled to sum to ``k``."""
    counts = class_counts(labels, k, label)
    base = F.col("n") + 1e-6
    counts = counts.withColumn("_w", 1 / (base if mode == "inverse" else F.sqrt(base)))
    total = F.sum("_w").over(Window.partitionBy(F.lit(0)))  # k rows
    return counts.select(label, "n", (F.col("_w") / total * k).alias("weight"))


def peak_to_peak(signals: DataFrame, window: int, keys: list[str] = SERIES) -> DataFrame:
    """Range of every full window of ``window`` samples; a shorter tail is dropped."""
    win = F.floor(F.col("sample_idx") / window).cast("bigint").alias("win")
    return signals.groupBy(*keys, win).agg(
        (F.max("value") - F.min("value")).alias("p2p"), F.count(F.lit(1)).alias("_n")
    ).filter(F.col("_n") == window).drop("_n")


def robust_z(df: DataFrame, keys: list[str], value: str, name: str = "z") -> DataFrame:
    """``(x - median) / (MAD / 0.67449)`` with exact medians of groups of any size."""
    med = exact_quantiles(df, keys, value, {"_med": 0.5})
    spread = F.xxhash64(*df.columns)
    centred = _attach(df, med, keys, spread).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    mad = exact_quantiles(centred, keys, "_dev", {"_mad": 0.5})
    out = _attach(centred, mad, keys, spread)
    return out.withColumn(
        name, F.try_divide(F.col(value) - F.col("_med"), F.col("_mad") / F.lit(NORMAL_MAD))
    ).drop("_med", "_dev", "_mad")


NORMAL_MAD = 0.6744897501960817  # third quartile of the standard normal distribution


def _attach(df: DataFrame, stats: DataFrame, keys: list[str], spread: Column) -> DataFrame:
    if not keys:
        row = stats.first()
        return df.select("*", *[F.lit(row[c]).alias(c) for c in stats.columns])
    return spread_join(df, stats, keys, spread)


def stage_durations(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("recording_id", "description").agg(F.sum("duration").alias("seconds"))


def bad_rate(flags: DataFrame, n_epochs: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Channels flagged in more than ``threshold`` of the epochs of their recording."""
    hits = flags.groupBy("recording_id", "channel").agg(F.count_distinct("epoch_idx").alias("n_bad"))
    out = hits.join(n_epochs, "recording_id").withColumn("rate", F.col("n_bad") / F.col("n_epochs"))
    return out.filter(F.col("rate") > threshold)


def confusion(predictions: DataFrame, k: int) -> DataFrame:
    """All ``k x k`` cells with counts and the row-normalised share (0 for an empty row)."""
    spark = predictions.sparkSession
    cells = spark.range(k * k).select(
        F.floor(F.col("id") / k).alias("y_true"), (F.col("id") % k).alias("y_pred")
    )
    seen = predictions.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    full = cells.join(seen, ["y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    row = F.sum("n").over(Window.partitionBy("y_true"))  # k rows
    return full.withColumn("recall", F.coalesce(F.try_divide(F.col("n"), row), F.lit(0.0)))


def class_scores(predictions: DataFrame, k: int) -> DataFrame:
    """Precision, recall, F1 and support per class; empty denominators give 0."""
    m = confusion(predictions, k)
    true = m.groupBy(F.col("y_true").alias("label")).agg(F.sum("n").alias("support"))
    pred = m.groupBy(F.col("y_pred").alias("label")).agg(F.sum("n").alias("_pred"))
    hit = m.filter("y_true = y_pred").select(F.col("y_true").alias("label"), F.col("n").alias("_hit"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = true.join(pred, "label").join(hit, "label")
    out = out.withColumn("precision", zero(F.try_divide(F.col("_hit"), F.col("_pred"))))
    out = out.withColumn("recall", zero(F.try_divide(F.col("_hit"), F.col("support"))))
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", zero(f1)).select("label", "precision", "recall", "f1", "support")


def scores(predictions: DataFrame, k: int) -> DataFrame:
    """Accuracy, balanced accuracy (mean recall of the classes that occur), macro and weighted averages."""
    c = class_scores(predictions, k)
    n = F.sum("support")
    w = lambda x: F.try_divide(F.sum(F.col(x) * F.col("support")), n)
    return c.agg(
        w("recall").alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        w("precision").alias("weighted_precision"), w("recall").alias("weighted_recall"), w("f1").alias("weighted_f1"),
        n.alias("support"),
    )


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean")
    )


def fold_summary(folds: DataFrame, value: str = "accuracy") -> DataFrame:
    return folds.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def standardize(signals: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Z-score per series over the whole record (population std; a constant series is only centred)."""
    stats = signals.groupBy(*keys).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    out = spread_join(signals, stats, keys, "sample_idx")
    z = (F.col("value") - F.col("_m")) / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))
    return out.withColumn("value", z).select(*signals.columns)


def standardize_epochs(signals: DataFrame, epoch_samples: int, keys: list[str] = SERIES) -> DataFrame:
    """Z-score inside every epoch and channel (sample std + 1e-8); the group is one epoch, so it is bounded."""
    w = Window.partitionBy(*keys, F.floor(F.col("sample_idx") / epoch_samples))
    z = (F.col("value") - F.avg("value").over(w)) / (F.coalesce(F.stddev_samp("value").over(w), F.lit(0.0)) + 1e-8)
    return signals.withColumn("value", z)


def best_by(df: DataFrame, keys: list[str], metric: str, order: str, largest: bool = True) -> DataFrame:
    """Row with the best metric per key; the smallest ``order`` wins ties."""
    cols = F.struct(*[c for c in df.columns if c not in keys])
    rank = F.struct((-F.col(metric) if largest else F.col(metric)).alias("m"), F.col(order).alias("o"))
    return df.groupBy(*keys).agg(F.min_by(cols, rank).alias("_b")).select(*keys, "_b.*")
