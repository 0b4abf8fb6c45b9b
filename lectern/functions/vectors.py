"""Vector functions as columns over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if either has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def similarity(a: Column, b: Column) -> Column:
    """Cosine moved to 0..1."""
    return (1 + cosine(a, b)) / 2


def unit(a: Column) -> Column:
    """The vector with length 1, or null."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def valid(a: Column, dimensions: int | None = None) -> Column:
    """Not null, of the dimension, all components finite and not all zero."""
    ok = a.isNotNull() & (F.size(a) > 0) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = ok & F.exists(a, lambda x: x != 0)
    return F.coalesce(ok & (F.size(a) == dimensions) if dimensions else ok, F.lit(False))
