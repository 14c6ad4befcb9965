"""Exact quantiles of groups of any size from radix histograms; no sort and no shuffle of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import spread_join
from .materialize import materialize

#: A bucket with fewer rows is resolved to single values at once.
SMALL_BUCKET = 1 << 16
_MANTISSA = 1 << 52


def ordered_bits(value: Column) -> Column:
    """The bits of a double as a bigint that sorts like the double; -0.0 counts as 0.0, NaN is the largest.

    Exponent and mantissa come from exact operations: a power of two, a division by it, a comparison.
    """
    size = F.abs(value)
    guess = F.greatest(F.lit(-1022.0), F.least(F.lit(1023.0), F.floor(F.log2(size)).cast("double")))
    below = size < F.pow(F.lit(2.0), guess)
    above = size / F.pow(F.lit(2.0), guess) >= 2
    power = F.when(below & (guess > -1022), guess - 1).when(above & (guess < 1023), guess + 1).otherwise(guess)
    share = size / F.pow(F.lit(2.0), power)  # in [1, 2), below 1 for subnormal numbers
    field = F.when(share < 1, F.lit(0).cast("bigint")).otherwise((power + 1023).cast("bigint"))
    part = F.when(share < 1, share).otherwise(share - 1)
    bits = field * F.lit(_MANTISSA) + (part * float(_MANTISSA)).cast("bigint")
    bits = F.when(size == 0, F.lit(0).cast("bigint")).when(size == float("inf"), F.lit(2047 * _MANTISSA)).otherwise(bits)
    return F.when(F.isnan(value), F.lit(2047 * _MANTISSA + 1)).when(value < 0, -bits).otherwise(bits)


def from_ordered_bits(bits: Column) -> Column:
    """The double of ``ordered_bits``."""
    size = F.abs(bits)
    field = F.shiftright(size, 52).cast("double")
    part = size.bitwiseAND(F.lit(_MANTISSA - 1)).cast("double") / float(_MANTISSA)
    tiny = part * F.pow(F.lit(2.0), F.lit(-1022.0))
    value = F.when(field == 0, tiny).otherwise((1 + part) * F.pow(F.lit(2.0), field - 1023))
    value = F.when(size == 2047 * _MANTISSA, F.lit(float("inf"))).when(size > 2047 * _MANTISSA, F.lit(float("nan"))).otherwise(value)
    return F.when(bits < 0, -value).otherwise(value)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Interpolated quantiles (NumPy ``linear`` rule) of the values that are not null.

    The rows are stored once as ordered bits. A pass counts rows by key and leading bits (at most 65,536 rows per key
    and wanted rank after the partial aggregation), finds the bucket of each wanted rank and goes on inside it with
    the next bits. Two passes leave about one row in a million; then the values themselves are counted, or the bits
    that are left when a bucket is still large. Rows are never sorted or moved.
    """
    stored = materialize(df.filter(F.col(value).isNotNull()).select(*keys, ordered_bits(F.col(value).cast("double")).alias("_code")))
    first = materialize(stored.groupBy(*keys, F.shiftright("_code", 48).alias("_at")).agg(F.count(F.lit(1)).alias("_n")))
    sizes = first.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    ranks = []
    for name, q in qs.items():
        at = (F.col("_size") - 1) * F.lit(float(q))
        ranks += [F.struct(F.lit(f"f_{name}").alias("name"), F.floor(at).alias("rank")), F.struct(F.lit(f"c_{name}").alias("name"), F.ceil(at).alias("rank"))]
    sizes = sizes.filter("_size > 0")
    want = sizes.select(*keys, "_size", F.explode(F.array(*ranks)).alias("_w")).select(
        *keys, "_size", "_w.*", F.lit(0).cast("bigint").alias("_in"), F.lit(0).cast("bigint").alias("_below"))
    want = _descend(first.withColumn("_in", F.lit(0).cast("bigint")), want, keys)
    shift = 48
    while shift:
        small = shift < 48 and (want.agg(F.max("_n")).first()[0] or 0) <= SMALL_BUCKET
        then = 0 if small else shift - 16
        targets = want.select(*keys, "_in").distinct()
        rows = spread_join(stored.withColumn("_in", F.shiftright("_code", shift)), targets, [*keys, "_in"], "_code")
        counts = rows.groupBy(*keys, "_in", F.shiftright("_code", then).alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
        want = _descend(counts, want.drop("_n"), keys)
        shift = then
    found = from_ordered_bits(F.col("_in"))
    picked = {f"{side}_{name}": F.max(F.when(F.col("name") == f"{side}_{name}", found)) for name in qs for side in "fc"}
    out = want.groupBy(*keys).agg(F.max("_size").alias("_size"), *[c.alias(f"_{n}") for n, c in picked.items()])
    for name, q in qs.items():
        at = (F.col("_size") - 1) * F.lit(float(q))
        low, high = F.col(f"_f_{name}"), F.col(f"_c_{name}")
        out = out.withColumn(name, F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at))))
    return out.select(*keys, *qs)


def _descend(counts: DataFrame, want: DataFrame, keys: list[str]) -> DataFrame:
    """Move each wanted rank into its bucket ``_at`` of the bucket ``_in`` it was in."""
    along = Window.partitionBy(*keys, "_in").orderBy("_at")  # at most 65,536 rows
    counts = counts.withColumn("_to", F.sum("_n").over(along))
    joined = want.join(counts, [*keys, "_in"])
    here = (F.col("_below") + F.col("_to") - F.col("_n") <= F.col("rank")) & (F.col("rank") < F.col("_below") + F.col("_to"))
    return materialize(joined.filter(here).select(
        *keys, "_size", "name", "rank", F.col("_at").alias("_in"),
        (F.col("_below") + F.col("_to") - F.col("_n")).alias("_below"), "_n"))
