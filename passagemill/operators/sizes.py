"""Broadcasts behind a check of the size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a table is broadcast; beyond either Spark joins by shuffle.
MOST_ROWS, MOST_BYTES = 1_000_000, 128 << 20


def width(name: str, kind: T.DataType) -> Column:
    """Bytes of a value, near enough."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.NumericType, T.BooleanType)):
        return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) * 8 + 16
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)) * 2 + 16
    return F.lit(8)


def is_small(df: DataFrame, most: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> bool:
    total = reduce(lambda a, b: a + b, (width(f.name, f.dataType) for f in df.schema.fields))
    n, size = df.limit(most + 1).select(total.cast("bigint").alias("w")).agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0))).first()
    return n <= most and size <= most_bytes


def small(df: DataFrame, most: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if it has at most so many rows and bytes, else as it is."""
    return F.broadcast(df) if is_small(df, most, most_bytes) else df
