"""Vector similarity as built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, vector: Sequence[float]) -> Column:
    """Cosine of a vector column and a constant; 0 if either has no length."""
    size = sum(x * x for x in vector) ** 0.5
    unit = F.array(*[F.lit(float(x) / size) for x in vector]) if size else F.array(*[F.lit(0.0) for _ in vector])
    n = norm(a)
    return F.when(n > 0, dot(a, unit) / n).otherwise(F.lit(0.0))


def cosine_columns(a: Column, b: Column) -> Column:
    """Cosine of two vector columns; 0 if either has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b.cast("array<double>")) / n).otherwise(F.lit(0.0))
