"""Vectors as arrays of floats, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNROLLED = 128  # dimensions up to which a product with a literal is written out, for code generation


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unequal or zero vectors."""
    length = norm(a) * norm(b)
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (length > 0)
    return F.when(usable, dot(a, b) / length).otherwise(0.0)


def dot_literal(a: Column, query: list[float]) -> Column:
    if len(query) > UNROLLED:
        return dot(a, F.array(*map(F.lit, query)))
    total = F.lit(0.0)
    for k, q in enumerate(query):
        total = total + F.get(a, F.lit(k)).cast("double") * F.lit(float(q))
    return total


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))
