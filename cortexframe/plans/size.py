"""Memory that a table takes, measured on its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _width(col: Column, kind: T.DataType) -> Column:
    """Bytes of a value in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.NumericType, T.BooleanType, T.DatetimeType)):
            return F.greatest(F.size(col), F.lit(0)) * 8 + 24
        parts = F.aggregate(col, F.lit(0).cast("bigint"), lambda acc, x: acc + _width(x, kind.elementType).cast("bigint"))
        return F.coalesce(parts, F.lit(0)) + 24
    if isinstance(kind, T.MapType):
        keys, values = T.ArrayType(kind.keyType), T.ArrayType(kind.valueType)
        return _width(F.map_keys(col), keys) + _width(F.map_values(col), values)
    if isinstance(kind, T.StructType):
        return sum((_width(col[f.name], f.dataType) for f in kind), F.lit(16))
    return F.lit(8)


def memory_bytes(stored: DataFrame) -> int:
    """Bytes that the rows of a stored table take in memory. Compressed file sizes do not bound it."""
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in stored.schema), F.lit(16))
    return int(stored.agg(F.sum(width.cast("bigint"))).first()[0] or 0)
