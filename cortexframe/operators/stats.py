"""Paired comparison of before/after spectra."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import t_two_sided
from ..plans.chunks import sequence_index
from .aggregates import mean_sem
from .signals import is_finite
from .windows import savgol

# Channels of the pairwise report.
REPORT_CHANNELS = ["Fp1", "P7", "P8", "O2", "F7", "C4", "T8"]
STRATEGIES = {"before_vs_before": ("before", "before"), "after_vs_after": ("after", "after"), "before_vs_after": ("before", "after")}
CELL = ["recording_id", "channel", "freq"]


def _condition(psd: DataFrame, name: str) -> DataFrame:
    return psd.filter(F.col("condition") == name).drop("condition")


def align_before_after(psd: DataFrame) -> DataFrame:
    """Before and after values of the same segment, channel and frequency side by side."""
    b = _condition(psd, "before").withColumnRenamed("power_db", "before_db")
    a = _condition(psd, "after").withColumnRenamed("power_db", "after_db")
    return b.join(a, ["recording_id", "segment_idx", "channel", "freq"])


def pair_segments(psd: DataFrame, shift: int, strategy: str) -> DataFrame:
    """Segment ``i`` of the first condition with segment ``i + shift`` of the second."""
    one, two = STRATEGIES[strategy]
    a = _condition(psd, one).withColumnRenamed("power_db", "first_db")
    b = _condition(psd, two).withColumnRenamed("power_db", "second_db").withColumn("segment_idx", F.col("segment_idx") - shift)
    return a.join(b, ["recording_id", "segment_idx", "channel", "freq"]).withColumn("strategy", F.lit(strategy))


@F.pandas_udf(T.DoubleType())
def _p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(dtype=float), df.to_numpy(dtype=float)))


def paired_t(pairs: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """t statistic of ``after - before`` over finite pairs: ``keys, n, t`` (null below two pairs)."""
    ok = pairs.filter(is_finite(F.col("before_db")) & is_finite(F.col("after_db")))
    d = F.col("after_db") - F.col("before_db")
    cells = pairs.select(*keys).distinct()
    s = ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("_m"), F.stddev_samp(d).alias("_s"))
    mean, err = F.col("_m"), F.col("_s") / F.sqrt(F.col("n").cast("double"))
    t = F.when(err > 0, F.try_divide(mean, err)).when(mean > 0, float("inf")).when(mean < 0, float("-inf")).otherwise(float("nan"))
    out = cells.join(s, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    return out.select(*keys, "n", F.when(F.col("n") >= 2, t).alias("t"))


def paired_ttest(pairs: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """Two-sided paired t-test per cell; fewer than two pairs give p = 1."""
    t = paired_t(pairs, keys)
    df = F.greatest(F.col("n") - 1, F.lit(1)).cast("double")
    p = F.when(F.col("t").isNull(), 1.0).otherwise(_p_value(F.coalesce("t", F.lit(0.0)), df))
    return t.withColumn("p", p)


def fdr_bh(tests: DataFrame, keys: list[str] = ["recording_id", "channel"], p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg over the finite p-values of a key.

    A key is one channel's frequency axis, so its window holds at most ``nperseg / 2 + 1`` rows.
    """
    finite = tests.filter(is_finite(F.col(p)))
    up = Window.partitionBy(*keys).orderBy(p)
    m = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    raw = finite.withColumn("_rank", F.row_number().over(up)).withColumn("_q", F.col(p) * m / F.col("_rank"))
    down = Window.partitionBy(*keys).orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    adj = raw.withColumn("p_adj", F.least(F.min("_q").over(down), F.lit(1.0))).drop("_rank", "_q")
    rest = tests.filter(~is_finite(F.col(p))).withColumn("p_adj", F.lit(1.0))
    return adj.unionByName(rest).withColumn("reject", F.col("p_adj") <= alpha)


def significant_bins(tests: DataFrame, fmin: float = 0.5, fmax: float = 40.0) -> DataFrame:
    return tests.filter(F.col("reject") & (F.col("freq") >= fmin) & (F.col("freq") <= fmax))


def shuffle_conditions(files: DataFrame, index: DataFrame, groups: int) -> DataFrame:
    """Assign files to condition groups by position: file ``(idx - 1) + i * groups`` in natural order.

    ``index`` holds ``(condition, i, idx)`` with ``i`` counting the picks of a condition.
    """
    numbered = sequence_index(files, ["folder"], ["natural"], "pos")
    wanted = index.select("condition", (F.col("idx") - 1 + F.col("i") * groups).alias("pos"))
    return numbered.join(wanted, "pos")


def before_after_report(
    psd: DataFrame, shift: int = 1, channels: list[str] | None = None, smooth: bool = True
) -> dict[str, DataFrame]:
    """Mean spectra with standard error, corrected tests, significant bins and the pairwise table."""
    pairs = align_before_after(psd)
    tests = fdr_bh(paired_ttest(pairs))
    wanted = F.col("channel").isin(REPORT_CHANNELS if channels is None else channels)
    pairwise = None
    for s in ("before_vs_after", "before_vs_before", "after_vs_after"):
        one = pair_segments(psd.filter(wanted), shift, s)
        pairwise = one if pairwise is None else pairwise.unionByName(one)
    if smooth:
        keys = ["strategy", "recording_id", "segment_idx", "channel"]
        first = savgol(pairwise, keys, value="first_db")
        second = savgol(pairwise, keys, value="second_db")
        pairwise = first.join(second, [*keys, "freq"])
    return {
        "mean": mean_sem(psd, ["recording_id", "condition", "channel", "freq"]),
        "tests": tests,
        "significant": significant_bins(tests),
        "pairwise": pairwise,
    }
