"""Functions of array columns, without Python."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    """Sum in the order of the elements."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def l2_normalized(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    size = norm(v)
    return F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v)


def clipped(x: Column, low: float = -4.0, high: float = 4.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def linspace(start: float, stop: float, n: int) -> Column:
    step = (stop - start) / (n - 1) if n > 1 else 0.0
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lit(start) + k * step)


def pair_name(a: Column, b: Column) -> Column:
    return F.concat_ws("_", a.cast("string"), b.cast("string"))
