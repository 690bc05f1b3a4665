"""Column functions over vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def cosine(a: Column, b: Column, digits: int = 6) -> Column:
    """Over the shorter of the two lengths; 0 for empty vectors and zero norms."""
    size = F.least(F.size(a), F.size(b))
    short = lambda v: F.slice(v, 1, size)
    norm = F.sqrt(_dot(short(a), short(a))) * F.sqrt(_dot(short(b), short(b)))
    return F.when((size <= 0) | (norm == 0), F.lit(0.0)).otherwise(F.round(_dot(short(a), short(b)) / norm, digits))


def hash_embedding(text: Column, dims: int) -> Column:
    """Deterministic vector from the bytes of SHA-256 of the normalised text, in [-1, 1]."""
    digest = F.sha2(F.lower(F.trim(text)).cast("binary"), 256)
    byte = lambda i: F.conv(F.substr(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.round(byte(i) / 127.5 - 1, 6))


def vector_errors(vector: Column, dims: int) -> Column:
    """Names of broken rules; empty for a valid vector."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.array_compact(F.array(F.when(vector.isNull() | (F.size(vector) != dims), F.lit("dimensions")), F.when(~F.coalesce(finite, F.lit(False)), F.lit("not_finite"))))
