"""Column builders for descriptor vectors. Components are widened to double before any arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(double(a), double(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(double(a), double(b), lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_normalize(v: Column) -> Column:
    """Unit vector; NaN components for a vector without length."""
    n = norm(v)
    return F.transform(double(v), lambda x: F.when(n == 0, F.lit(float("nan"))).otherwise(F.try_divide(x, n)))
