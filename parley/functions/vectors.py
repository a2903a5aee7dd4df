"""Vector arithmetic as column expressions; sums run in element order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Null where the lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def valid(a: Column) -> Column:
    """Non-null, non-empty, of finite numbers and not zero."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(a) > 0) & finite & F.exists(a, lambda x: x != 0), F.lit(False))


def unit(a: Column) -> Column:
    """The vector at length one; null for an invalid one."""
    return F.when(valid(a), F.transform(a, lambda x: x / norm(a)))


def cosine(a: Column, b: Column) -> Column:
    """Unclamped; null where the lengths differ or either vector is invalid."""
    return F.when(valid(a) & valid(b), dot(a, b) / (norm(a) * norm(b)))


def clamped_cosine(a: Column, b: Column) -> Column:
    """In [-1, 1]; -1 where cosine is null."""
    value = cosine(a, b)  # greatest and least leave nulls out
    return F.when(value.isNull() | (value < -1), F.lit(-1.0)).when(value > 1, F.lit(1.0)).otherwise(value)


def rounded(a: Column, digits: int = 6) -> Column:
    return F.transform(a, lambda x: F.round(x, digits))


def as_text(a: Column, digits: int = 4) -> Column:
    """Comparable text of a vector."""
    return F.array_join(F.transform(a, lambda x: F.format_string(f"%.{digits}f", F.round(x, digits) + F.lit(0.0))), " ")
