"""Broadcast only what is counted and small, in rows and in bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64_000_000


def _numbers(value: Column, kind: T.DataType) -> Column:
    """How many numbers a value holds; nested arrays are measured by their parts."""
    if not isinstance(kind, T.ArrayType):
        return F.lit(1).cast("long")
    if isinstance(kind.elementType, T.ArrayType):
        return F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + _numbers(x, kind.elementType))
    return F.coalesce(F.size(value), F.lit(0)).cast("long")


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and ``size`` bytes (eight a number); counting stops
    beyond the rows."""
    held = sum((_numbers(F.col(f.name), f.dataType) for f in df.schema), F.lit(0).cast("long"))
    n, numbers = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(held), F.lit(0))).first()
    return n <= rows and 8 * numbers <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint where it is small."""
    return F.broadcast(df) if is_small(df, rows, size) else df
