"""Vector similarities over array columns, and null-safe ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumeria.functions.dates import column


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda total, x: total + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return _sum(F.zip_with(column(a), column(b), lambda x, y: x.cast("double") * y))


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)


def closeness(a: str | Column, b: str | Column) -> Column:
    """``1 / (1 + euclidean distance)``."""
    gap = F.zip_with(column(a), column(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return 1 / (1 + F.sqrt(_sum(gap)))


def ratio(a: str | Column, b: str | Column) -> Column:
    """``a / b``, null when ``b`` is zero or null."""
    return F.try_divide(column(a), column(b))


def capped(a: str | Column) -> Column:
    return F.least(column(a), F.lit(1.0))
