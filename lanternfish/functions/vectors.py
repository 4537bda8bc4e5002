"""Vector functions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 4


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if lengths differ or a norm is 0."""
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def to_unit_range(c: Column) -> Column:
    return F.least(F.greatest((c + 1) / 2, F.lit(0.0)), F.lit(1.0))


def blend(cosine01: Column, keyword: Column) -> Column:
    """Seven tenths similarity, three tenths keywords."""
    return 0.7 * cosine01 + 0.3 * keyword
