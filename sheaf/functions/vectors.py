"""Vector functions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 where a vector has no length, within -1..1."""
    size = norm(a) * norm(b)
    return F.when(size > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size))).otherwise(0.0)


def unit(a: Column) -> Column:
    """The vector at length 1; null where it has no length."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda v: v.cast("double") / n))


def usable(a: Column, dimensions: Column) -> Column:
    """Whether a vector has its space's dimensions, only finite numbers, and a length."""
    sound = F.forall(a, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(a) == dimensions) & sound & (norm(a) > 0), F.lit(False))


def fused(cosine_: Column, keyword: Column, weight: float = 0.01) -> Column:
    """Cosine with the keyword score as a tie-break."""
    return cosine_ + weight * F.coalesce(keyword, F.lit(0.0))
