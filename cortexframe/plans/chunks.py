"""Ordered computations that never put a whole key into one task.

A window over ``(recording, channel)`` sends each series to a single task. The functions here work on
``(key, chunk)`` instead, where a chunk is a bounded, contiguous stretch of the order: local windows run
inside the chunks, one summary row per chunk carries the state across, and the carried state is joined back.
Signals have a dense ``sample_idx``, so their chunk is plain arithmetic; other tables get balanced chunks
from a range partitioning whose result is written once, which keeps chunk numbers stable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import MAX_BROADCAST_BYTES
from .materialize import materialize
from .size import memory_bytes

SERIES = ["recording_id", "channel"]
CHUNK = "_chunk"
CHUNK_SAMPLES = 65536


def signal_chunks(df: DataFrame, size: int = CHUNK_SAMPLES, index: str = "sample_idx") -> DataFrame:
    """Number bounded chunks of a dense integer index."""
    return df.withColumn(CHUNK, F.floor(F.col(index) / size).cast("bigint"))


def sample_halo(df: DataFrame, before: int, after: int, size: int = CHUNK_SAMPLES, index: str = "sample_idx") -> DataFrame:
    """Repeat the rows near a chunk border in the neighbouring chunk.

    A window over ``(keys, chunk)`` then sees ``before`` rows to the left and ``after`` to the right of every
    own row (``_own``), so ``lag`` / ``lead`` on a dense index need one shuffle and no per-series task.
    """
    first = F.floor((F.col(index) - after) / size).cast("bigint")
    last = F.floor((F.col(index) + before) / size).cast("bigint")
    out = df.withColumn(CHUNK, F.explode(F.sequence(first, last)))
    return out.withColumn("_own", F.floor(F.col(index) / size) == F.col(CHUNK))


def range_chunks(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None, row: str | None = None) -> DataFrame:
    """Number balanced chunks of ``(keys, order)``; a hot key simply spans many chunks.

    The rows are stored and counted first, so a chunk holds about ``CHUNK_SAMPLES`` rows at any size of the input. With
    several chunks, column ``row`` numbers the rows of a chunk along ``(keys, order)``, without gaps.
    """
    if parts is None:
        df = materialize(df)
        parts = max(1, -(-df.count() // CHUNK_SAMPLES))
        if parts == 1:
            return df.withColumn(CHUNK, F.lit(0).cast("bigint"))
    ranged = df.repartitionByRange(parts, *[F.col(c) for c in [*keys, *order]])
    if row:
        ranged = ranged.sortWithinPartitions(*keys, *order).withColumn(row, F.monotonically_increasing_id())
    return materialize(ranged.withColumn(CHUNK, F.spark_partition_id().cast("bigint")))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    specs: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Running ``sum`` / ``max`` / ``count`` over ``order`` within ``keys`` (not null) for a chunked table.

    ``specs`` maps an output name to ``(function, expression)``. ``inclusive`` counts the current row. The
    carry joins on ``(keys, chunk)``, the partitioning the local window already has, so rows move once.
    """
    fns = {"sum": F.sum, "max": F.max, "count": F.count}
    parts = [*keys, CHUNK]
    local = Window.partitionBy(*parts).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*parts).agg(*[fns[f](e).alias(f"_t_{n}") for n, (f, e) in specs.items()])
    carry = totals.select(
        *parts, *[(F.max if f == "max" else F.sum)(f"_t_{n}").over(before).alias(f"_c_{n}")
                  for n, (f, _) in specs.items()]
    )
    out = df.select("*", *[fns[f](e).over(local).alias(f"_l_{n}") for n, (f, e) in specs.items()])
    out = out.join(carry, parts, "left")
    for n, (f, _) in specs.items():
        left, right = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if f == "max":
            value = F.greatest(left, right)
        else:
            value = F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))
        out = out.withColumn(n, value).drop(f"_l_{n}", f"_c_{n}")
    return out


def neighbour(
    df: DataFrame, keys: list[str], order: list[str], cols: list[str], step: int, name: str
) -> DataFrame:
    """Struct column ``name`` with ``cols`` of the previous (-1) or next (+1) row of the key."""
    parts = [*keys, CHUNK]
    local = Window.partitionBy(*parts).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    payload = F.struct(*cols)
    at = F.struct(*order)
    if step == -1:
        edge = df.groupBy(*parts).agg(F.max_by(payload, at).alias("_e"))
        edge = edge.select(*parts, F.lag("_e").over(across).alias("_edge"))
        near = F.lag(payload).over(local)
    elif step == 1:
        edge = df.groupBy(*parts).agg(F.min_by(payload, at).alias("_e"))
        edge = edge.select(*parts, F.lead("_e").over(across).alias("_edge"))
        near = F.lead(payload).over(local)
    else:
        raise ValueError("step must be -1 or 1")
    out = df.withColumn("_near", near).join(edge, parts, "left")
    return out.withColumn(name, F.coalesce("_near", "_edge")).drop("_near", "_edge")


def runs(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Maximal runs of equal ``value`` in row order: gaps-and-islands in one pass over the rows.

    Runs are cut inside chunks first; only the first and last run of a chunk can continue elsewhere, so the
    stitching step sees at most two rows per chunk. Returns ``keys, value, run_start, run_end, run_len,
    is_last`` where start and end are order values and ``is_last`` marks the final run of the key.
    """
    parts = [*keys, CHUNK]
    w = Window.partitionBy(*parts).orderBy(order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    cut = df.select(*keys, CHUNK, order, value).withColumn("_new", changed)
    cut = cut.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    local = cut.groupBy(*parts, "_run").agg(
        F.first(value).alias(value), F.min(order).alias("run_start"), F.max(order).alias("run_end"),
        F.count(F.lit(1)).alias("run_len"),
    )
    # the shuffle of the cut runs is shared by both branches below, so the rows are sorted once
    local = local.repartition(*parts)
    chunk_w = Window.partitionBy(*parts)
    local = local.withColumn("_runs", F.max("_run").over(chunk_w))
    inner = local.filter((F.col("_run") > 1) & (F.col("_run") < F.col("_runs")))
    edge = local.filter((F.col("_run") == 1) | (F.col("_run") == F.col("_runs")))
    seq = Window.partitionBy(*keys).orderBy(CHUNK, "_run")
    joins = (
        (F.col("_run") == 1) & F.lag("_chunk").over(seq).isNotNull()
        & (F.lag("_run").over(seq) == F.lag("_runs").over(seq))
        & F.lag(value).over(seq).eqNullSafe(F.col(value))
    )
    edge = edge.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("_tail", F.lead("_run").over(seq).isNull())
    edge = edge.withColumn("_id", F.sum("_new").over(seq.rowsBetween(Window.unboundedPreceding, 0)))
    stitched = edge.groupBy(*keys, "_id").agg(
        F.first(value).alias(value), F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"),
        F.sum("run_len").alias("run_len"), F.max("_tail").alias("is_last"),
    )
    cols = [*keys, value, "run_start", "run_end", "run_len", "is_last"]
    return stitched.select(*cols).unionByName(inner.withColumn("is_last", F.lit(False)).select(*cols))


def sequence_index(
    df: DataFrame, keys: list[str], order: list[str], name: str, parts: int | None = None
) -> DataFrame:
    """Zero-based dense position of every row within ``keys`` along ``order``.

    Each chunk is sorted and its rows are numbered as it is written, so a key's rows in a chunk have consecutive numbers.
    One row per key and chunk then says by how much they are shifted.
    """
    chunked = range_chunks(df, keys, order, parts, "_seq_row")
    if "_seq_row" not in chunked.columns:
        return running(chunked, keys, order, {name: ("count", F.lit(1))}, inclusive=False).drop(CHUNK)
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    sizes = chunked.groupBy(*keys, CHUNK).agg(F.min("_seq_row").alias("_seq_first"), F.count(F.lit(1)).alias("_seq_n"))
    shift = F.coalesce(F.sum("_seq_n").over(before), F.lit(0)) - F.col("_seq_first")
    shifts = materialize(sizes.select(
        *[F.col(k).alias(f"_seq_{i}") for i, k in enumerate(keys)], F.col(CHUNK).alias("_seq_chunk"), shift.alias("_seq_by")))
    same = F.col(CHUNK) == F.col("_seq_chunk")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_seq_{i}"))
    small = memory_bytes(shifts) <= MAX_BROADCAST_BYTES  # else both sides meet on the chunk, which bounds a hot key
    out = chunked.join(F.broadcast(shifts) if small else shifts, same).withColumn(name, F.col("_seq_row") + F.col("_seq_by"))
    return out.select(*df.columns, *([] if name in df.columns else [name]))
