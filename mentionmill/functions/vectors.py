"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _d(v: str | Column) -> Column:
    return F.transform(F.col(v) if isinstance(v, str) else v, lambda x: x.cast("double"))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def similarity(a: str | Column, b: str | Column) -> Column:
    """Cosine as 0 to 100, negative ones 0."""
    return F.greatest(F.lit(0.0), cosine(a, b)) * 100
