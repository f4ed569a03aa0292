"""Cosine similarity of arrays."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noteloom.functions.text import col


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a, b, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Zero for different lengths, empty vectors and zero norms."""
    a, b = col(a), col(b)
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0), dot(a, b) / size).otherwise(0.0)


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector)) if vector else F.array().cast("array<double>")
