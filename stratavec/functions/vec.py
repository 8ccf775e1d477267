"""Column builders over dense vectors (arrays of numbers); all arithmetic is in double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Distance = Callable[[Column, Column], Column]


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def l2sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(l2sq(a, b))


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def residual(x: Column, c: Column) -> Column:
    """x - c, element by element."""
    return F.zip_with(doubles(x), doubles(c), lambda a, b: a - b)


def scaled(v: Column, by: float) -> Column:
    """Every element divided by ``by``: 255 for pixels."""
    return F.transform(doubles(v), lambda x: x / F.lit(float(by)))


def splits(dim: int, parts: int) -> list[tuple[int, int]]:
    """(start, size) of ``parts`` blocks of nearly equal size; the first ``dim % parts`` get one
    more, and blocks beyond ``dim`` are empty."""
    out, start = [], 0
    for i in range(parts):
        size = dim // parts + (i < dim % parts)
        out.append((start, size))
        start += size
    return out


def part(v: Column, start: int, size: int) -> Column:
    """The block of a vector that begins at ``start`` (from 0)."""
    return F.slice(v, start + 1, size)


def floor_hash(v: Column, direction: Column, offset: Column, width: float) -> Column:
    """The p-stable hash floor((v . direction + offset) / width)."""
    return F.floor((dot(v, direction) + offset) / F.lit(float(width))).cast("long")


def valid(v: Column, dim: int | None = None) -> Column:
    """Whether a vector is present, of the given dimension, without null or non-finite elements."""
    finite = F.forall(doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = v.isNotNull() & (F.size(v) > 0) & finite
    return F.coalesce(ok if dim is None else ok & (F.size(v) == dim), F.lit(False))
