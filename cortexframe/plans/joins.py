"""Joins of a large table with a table of one row per key: statistics, channel lists, reference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .materialize import materialize
from .size import memory_bytes

MAX_BROADCAST_BYTES = 64 << 20  # of rows in memory
SALTS = 32


def spread_join(
    big: DataFrame, small: DataFrame, keys: list[str], spread: str | Column, how: str = "inner",
    max_bytes: int = MAX_BROADCAST_BYTES, salts: int = SALTS,
) -> DataFrame:
    """Equi-join that neither shuffles ``big`` without need nor gathers a hot key in one task.

    The ``small`` side is stored first, so it is computed once and its rows can be measured: up to ``max_bytes`` in
    memory it is broadcast and ``big`` is not moved. Beyond that both sides meet on the key plus a salt: ``small`` is
    repeated per salt and ``big`` takes its salt from ``spread``, so a key with a third of all rows is joined
    by ``salts`` tasks.
    """
    stored = materialize(small)
    if memory_bytes(stored) <= max_bytes:
        return big.join(F.broadcast(stored), keys, how)
    salt = F.pmod(F.hash(spread if isinstance(spread, Column) else F.col(spread)), F.lit(salts))
    salted = stored.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", salt).join(salted, [*keys, "_salt"], how).drop("_salt")


def lookup_join(big: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner", max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``spread_join`` that takes the salt from the whole row."""
    return spread_join(big, lookup, keys, F.xxhash64(*big.columns), how, max_bytes)


def place_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Join of rows that ``keys`` name one by one on both sides, such as blocks: no key can be hot.

    ``small`` is stored and measured; up to ``max_bytes`` it is broadcast.
    """
    stored = materialize(small)
    return big.join(F.broadcast(stored) if memory_bytes(stored) <= max_bytes else stored, keys, how)


def bounded_collect(df: DataFrame, max_rows: int, what: str) -> list:
    """Collect a small result (maps, weights, templates) and refuse anything larger."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what} has more than {max_rows} rows")
    return rows
