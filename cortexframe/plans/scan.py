"""Parallel prefix over numbered rows whose states follow ``z' = M z + v``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .materialize import drop_table, materialize

#: Powers of the transition below this size add nothing to a double.
NEGLIGIBLE = 1e-20


def _times(matrix: np.ndarray, vector: Column) -> list[Column]:
    """The entries of ``matrix`` times an array column."""
    return [
        sum((F.lit(float(c)) * F.get(vector, F.lit(j)) for j, c in enumerate(row) if c), F.lit(0.0)) for row in matrix
    ]


def affine_scan(df: DataFrame, keys: list[str], index: str, vector: str, matrix: np.ndarray, name: str, backward: bool = False) -> DataFrame:
    """``keys, index, name``: the state in which each row starts, zero for the first one of a key.

    ``index`` numbers the rows of a key without gaps. Round ``r`` adds to each row what the row ``2 ** r`` places before it
    has gathered, moved on by ``matrix ** 2 ** r``: an equi-join on ``(keys, index)``, written per round. Rounds end when
    they reach the longest key or when the power of a decaying matrix vanishes, so a key is never in one task.
    """
    step = -1 if backward else 1
    size = len(matrix)
    now = materialize(df.select(*keys, index, F.col(vector).alias("_v")))
    longest = now.agg(F.max(index) - F.min(index)).first()[0] or 0
    reach, power = 1, np.asarray(matrix, float)
    while reach <= longest and np.abs(power).max() > NEGLIGIBLE:
        before = now.select(*keys, (F.col(index) + step * reach).alias(index), F.col("_v").alias("_b"))
        moved = _times(power, F.col("_b"))
        added = F.array(*[F.get("_v", F.lit(i)) + moved[i] for i in range(size)])
        joined = now.join(before, [*keys, index], "left")
        then = materialize(joined.select(*keys, index, F.when(F.col("_b").isNull(), F.col("_v")).otherwise(added).alias("_v")))
        drop_table(now)
        now, reach, power = then, 2 * reach, power @ power
    before = now.select(*keys, (F.col(index) + step).alias(index), F.col("_v").alias(name))
    out = now.select(*keys, index).join(before, [*keys, index], "left")
    return out.withColumn(name, F.coalesce(name, F.array(*[F.lit(0.0)] * size)))
