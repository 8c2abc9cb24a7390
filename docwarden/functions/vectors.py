"""Vector expressions over array<float> columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EMBEDDING_DIM = 1536  # fixed value: vector length of the stored embeddings


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """NULL for a zero vector, which has no direction."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def invalid_vector_reason(vector: Column, dim: int = EMBEDDING_DIM) -> Column:
    """NULL when usable, else the first thing wrong with the vector."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    numeric = F.forall(vector, lambda x: x.isNotNull())
    return (
        F.when(vector.isNull(), "missing")
        .when(F.size(vector) != dim, F.concat(F.lit(f"expected {dim} values, got "), F.size(vector).cast("string")))
        .when(~numeric, "non-numeric value")
        .when(~finite, "non-finite value")
    )
