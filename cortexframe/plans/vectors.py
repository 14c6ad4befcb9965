"""Sums of vectors: partial sums in the tasks, one vector per key and task in the shuffle."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sum_vectors(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``keys, column``: the element-wise sum of an array column. The arrays of a key have one length."""
    total = vector_to_array(Summarizer.sum(array_to_vector(F.col(column)))).alias(column)
    return df.groupBy(*keys).agg(total)
