"""Vector expressions on array<float> / array<double> columns, in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def total(a: Column) -> Column:
    return _sum(a)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_raw(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1], 0 when a vector is zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths)


def cosine(a: Column, b: Column) -> Column:
    """Cosine clipped to [0, 1], 0 when a vector is zero."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine_raw(a, b)))


def centred(a: Column) -> Column:
    mean = total(a) / F.size(a)
    return F.transform(a, lambda x: x.cast("double") - mean)


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two vectors, 0 when one is constant."""
    ca, cb = centred(a), centred(b)
    lengths = norm(ca) * norm(cb)
    flat = (F.array_max(a) == F.array_min(a)) | (F.array_max(b) == F.array_min(b))
    return F.when(flat, F.lit(0.0)).otherwise(dot(ca, cb) / lengths)


def euclidean(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(_sum(F.transform(gaps, lambda g: g * g)))


def unit(a: Column, floor: float = 1e-12) -> Column:
    """The vector divided by its length, the length floored against zero."""
    length = F.greatest(norm(a), F.lit(floor))
    return F.transform(a, lambda x: x.cast("double") / length)


def pair_count(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("long")
