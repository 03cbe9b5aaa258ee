"""Vector expressions over ``ARRAY<DOUBLE>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"), lambda acc, p: acc + p
    )


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def l2_normalize(v: Column, eps: float = 1e-10) -> Column:
    """Unit vector; a norm below ``eps`` is replaced by ``eps``."""
    length = F.greatest(norm(v), F.lit(eps))
    return F.transform(v, lambda x: x / length)


def centroid_normalize(v: Column, eps: float = 1e-8) -> Column:
    """Unit vector of a mean; ``eps`` is added to the norm."""
    length = norm(v) + F.lit(eps)
    return F.transform(v, lambda x: x / length)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-10)) * F.greatest(norm(b), F.lit(1e-10)))
