"""Vector functions as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where sizes differ, a vector is empty or has no length; null where a vector is."""
    size = norm(a) * norm(b)
    same = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(a.isNull() | b.isNull(), None).when(same & (size > 0), dot(a, b) / F.when(size > 0, size)).otherwise(0.0)


def normalize_l2(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / F.when(n > 0, n))).otherwise(F.transform(a, lambda x: x.cast("double")))


def clipped(a: Column, dim: int) -> Column:
    return F.slice(a, 1, dim)
