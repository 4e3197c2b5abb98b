"""Vector arithmetic on array columns, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a / |a|; the null vector stays. The norm is bound as a variable: named in the inner lambda it would be worked out for each element."""
    scaled = F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(doubles(a), lambda x: x / n)).otherwise(doubles(a)))
    return F.get(scaled, F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def l2sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
