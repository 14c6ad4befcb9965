"""Losses and scores over prediction/target arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def _dot(a: str, b: str) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def cosine(pred: str = "pred", target: str = "target", eps: float = 1e-8) -> Column:
    """Cosine similarity of two arrays; norms are at least ``eps``."""
    norm = lambda c: F.greatest(F.sqrt(_dot(c, c)), F.lit(eps))
    return _dot(pred, target) / (norm(pred) * norm(target))


def cosine_loss(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg(1 - cosine()).alias("loss"))


def _mean_over_elements(pairs: DataFrame, per: Column, name: str) -> DataFrame:
    total = _sum(F.zip_with("pred", "target", lambda p, t: per(p, t)))
    return pairs.agg((F.sum(total) / F.sum(F.size("pred"))).alias(name))


def mse(pairs: DataFrame) -> DataFrame:
    return _mean_over_elements(pairs, lambda p, t: (p - t) * (p - t), "mse")


def lp_loss(pairs: DataFrame, p: float = 1.0) -> DataFrame:
    """Mean of ``|d|**p / p`` over all elements."""
    return _mean_over_elements(pairs, lambda a, b: F.pow(F.abs(a - b), F.lit(float(p))) / F.lit(float(p)), "loss")


def masked_smooth_l1(pairs: DataFrame, mask: str = "mask", beta: float = 1.0) -> DataFrame:
    """Smooth L1 over the masked elements, divided by their number."""
    d = F.zip_with("pred", "target", lambda a, b: F.abs(a - b))
    each = F.transform(d, lambda x: F.when(x < beta, 0.5 * x * x / beta).otherwise(x - 0.5 * beta))
    hit = F.zip_with(each, mask, lambda e, m: e * m.cast("double"))
    n = _sum(F.transform(mask, lambda m: m.cast("double")))
    return pairs.agg((F.sum(_sum(hit)) / (F.sum(n) + 1e-8)).alias("loss"))


def snr_db(pairs: DataFrame) -> DataFrame:
    """``10 log10(mean t**2 / (mean (p - t)**2 + 1e-8))`` over all elements."""
    n = F.sum(F.size("pred"))
    signal = F.sum(_dot("target", "target")) / n
    noise = F.sum(_sum(F.zip_with("pred", "target", lambda p, t: (p - t) * (p - t)))) / n
    return pairs.agg((10 * F.log10(signal / (noise + 1e-8))).alias("snr_db"))


def decode(logits: DataFrame, column: str = "logits") -> DataFrame:
    """Class of the largest logit (first on ties)."""
    return logits.withColumn("y_pred", (F.array_position(column, F.array_max(column)) - 1).cast("bigint"))


def accuracy(decoded: DataFrame) -> DataFrame:
    hit = F.count_if(F.col("y_true") == F.col("y_pred"))
    n = F.count(F.lit(1))
    return decoded.agg(hit.alias("correct"), n.alias("total"), F.try_divide(hit, n).alias("accuracy"))
