"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(vector: Column) -> Column:
    return F.sqrt(_dot(vector, vector))


def dimension(vector: Column) -> Column:
    return F.size(vector)


def cosine_distance(a: Column, b: Column) -> Column:
    """Row-wise distance of two vector columns of one row (searches use the block product)."""
    return F.lit(1.0) - _dot(a, b) / (l2_norm(a) * l2_norm(b))


def similarity(distance: Column) -> Column:
    return F.round(F.lit(1.0) - distance, 4)


def relevance(distance: Column) -> Column:
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.greatest(distance, F.lit(0.0))), 4)


def vector_literal(vector: Column) -> Column:
    """Array to ``[a,b,...]`` text."""
    return F.concat(F.lit("["), F.array_join(vector.cast("array<string>"), ","), F.lit("]"))


def parse_vector_literal(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def flatten_vector(nested: Column) -> Column:
    """Unwrap a vector delivered inside a one-element array."""
    return F.flatten(nested)
