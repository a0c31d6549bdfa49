"""Vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEMANTIC_WEIGHT, LEXICAL_WEIGHT = 0.3, 0.7


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty, zero or unequally long vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0)
    return F.coalesce(F.when(usable, F.try_divide(dot(a, b), norm)), F.lit(0.0))


def unit_range(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def blend(lexical: Column, semantic: Column) -> Column:
    return LEXICAL_WEIGHT * unit_range(lexical) + SEMANTIC_WEIGHT * unit_range(semantic)
