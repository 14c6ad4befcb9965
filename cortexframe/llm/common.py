"""Shared helpers of the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.joins import spread_join
from ..plans.materialize import materialize
from .kernels import text_bytes

WHITE_SPACE = r"[ \t\n\x0B\f\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE_SPACE), "")


def with_row_key(docs: DataFrame, *cols: str) -> DataFrame:
    """``cols`` plus ``row_key``, two 64-bit hashes of ``doc_id`` and ``text``.

    Rows that agree in both are copies of one row and share the key.
    """
    return docs.select(*cols, row_key().alias("row_key"))


def row_key() -> Column:
    parts = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("text").isNull(), F.col("text")]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *reversed(parts)).alias("b"))


#: Bytes in one batch between Spark and a worker; both sides hold a few of them.
BATCH_BYTES = 8 << 20


def map_texts(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` for rows with long texts: batches are bounded in bytes (for the session, as Spark plans late)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about ``limit`` bytes of text, or one longer text."""
    lengths = pc.binary_length(batch.column(column)).to_pylist()
    start, size = 0, 0
    for i, n in enumerate(lengths):
        size += n or 0
        if size >= limit:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < len(lengths):
        yield batch.slice(start)


def text_parts(texts: pa.Array, size: int, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The bytes of texts in groups of about ``size``: data, offsets of the parts, their text numbers and first bytes.

    A longer text is cut into parts that share ``overlap`` bytes with the next one, so each stretch of ``overlap + 1`` bytes
    starts in exactly one part's first ``size`` bytes. Empty texts have no part.
    """
    data, offsets = text_bytes(texts)
    n = np.diff(offsets)
    count = np.where(n > 0, np.maximum(1, -(-(n - overlap) // size)), 0)
    owner = np.repeat(np.arange(len(n)), count)
    base = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * size
    stop = np.minimum(n[owner], base + size + overlap)
    ends = np.cumsum(stop - base)
    lo = 0
    while lo < len(owner):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size + overlap, "right")))
        own = slice(lo, hi)
        first = offsets[owner[own]]
        pieces = [data[a:b] for a, b in zip(first + base[own], first + stop[own])]
        yield np.concatenate(pieces), np.concatenate(([0], np.cumsum([len(p) for p in pieces]))), owner[own], base[own]
        lo = hi


def heat_join(big: DataFrame, side: DataFrame, keys: list[str], spread: Column, how: str = "inner", rows_per_task: int = 4000, counts: DataFrame | None = None) -> DataFrame:
    """Equi-join of ``big`` with ``side`` (one row per key) that copies only the rows of frequent keys.

    A key with more than ``rows_per_task`` rows in ``big`` is cut into as many parts as it needs; ``side`` is repeated
    once per part, so the copies stay below ``big / rows_per_task``. ``counts`` (keys and ``_n``) saves the counting.
    """
    if counts is None:
        counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") > rows_per_task)
    hot = materialize(hot.select(*keys, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_parts")))
    left = spread_join(big, hot, keys, spread, "left")
    left = left.withColumn("_part", F.pmod(F.hash(spread), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    right = spread_join(side, hot, keys, F.xxhash64(*keys), "left")
    right = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return left.join(right.drop("_parts"), [*keys, "_part"], how).drop("_part")


class GramFilter:
    """Bitmap of a bounded size that holds every repeated gram and lets a few others through."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 64 - 1)

    def holds(self, grams: np.ndarray) -> np.ndarray:
        at = grams & self.mask
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


class RepeatedGrams:
    """Grams that occur at least twice, from partial counts of the tasks.

    Tasks use them as a bitmap of at most ``MAX_BITS`` bits. A gram that passes by chance costs work, not correctness:
    nothing equal to its stretch is found later.
    """

    SCHEMA = "gram bigint, n int"
    MAX_BITS = 1 << 28

    def __init__(self, counts: DataFrame):
        self.grams = materialize(counts.groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1").select("gram"))

    @staticmethod
    def partial(grams: np.ndarray) -> pa.RecordBatch:
        values, n = np.unique(grams, return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(values.view(np.int64)), pa.array(np.minimum(n, 2), pa.int32())], names=["gram", "n"]
        )

    def broadcast(self):
        bits, grams = 1 << 20, self.grams.count()
        while bits < self.MAX_BITS and bits < 16 * grams:
            bits <<= 1
        at = F.col("gram").bitwiseAND(F.lit(bits - 1))
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int"))
        rows = self.grams.select(F.shiftright(at, 6).alias("word"), bit.alias("bit"))
        packed = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most bits / 64 rows
        out = np.zeros(bits // 64, np.uint64)
        out[packed.column("word").to_numpy()] = packed.column("bits").to_numpy().view(np.uint64)
        return self.grams.sparkSession.sparkContext.broadcast(GramFilter(out))
