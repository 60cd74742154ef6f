"""Column functions on embedding vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_DIMENSIONS = 8192


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where lengths differ or a norm is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def is_valid(v: Column, dimensions: int | None = None) -> Column:
    """Non-empty, finite, non-zero, not too long, and of the index's length."""
    fine = v.isNotNull() & F.size(v).between(1, MOST_DIMENSIONS) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = fine & F.exists(v, lambda x: x != 0)
    return fine & (F.size(v) == dimensions) if dimensions else fine
