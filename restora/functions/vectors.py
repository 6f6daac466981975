"""Vectors as array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    """Euclidean norm; 1e-10 for the zero vector."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x, lambda s: F.when(s == 0, F.lit(1e-10)).otherwise(F.sqrt(s)))


def unit(v: Column) -> Column:
    # as the variable of an outer lambda the norm is taken once, not at every component
    return F.get(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x / n)), F.lit(0))


def product(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x between low and high; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))
