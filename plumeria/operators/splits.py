"""Time splits. Every predicate is a plain comparison, so scans can prune on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeria.functions.dates import column, minus_days, plus_days


def train_until(df: DataFrame, when: str, split: Column) -> DataFrame:
    return df.where(F.col(when) <= split)


def test_after(df: DataFrame, when: str, split: Column, end: Column | None = None) -> DataFrame:
    """Rows after the split, up to ``end`` where one is given."""
    later = df.where(F.col(when) > split)
    return later if end is None else later.where(F.col(when) <= end)


def train_before(df: DataFrame, when: str, split: Column) -> DataFrame:
    return df.where(F.col(when) < split)


def test_from(df: DataFrame, when: str, split: Column) -> DataFrame:
    return df.where(F.col(when) >= split)


def on_day(df: DataFrame, when: str, day: Column) -> DataFrame:
    """Rows of one calendar day, as a range test on the raw column."""
    return df.where((F.col(when) >= day) & (F.col(when) < plus_days(day, 1)))


def trailing(df: DataFrame, when: str, split: Column, days: int = 28) -> DataFrame:
    """Rows in the half-open window ``(split - days, split]``."""
    return df.where((F.col(when) > minus_days(split, days)) & (F.col(when) <= split))


def since(df: DataFrame, when: str, as_of: Column, days: int = 2) -> DataFrame:
    """Rows not older than ``days`` before ``as_of``."""
    return df.where(F.col(when) >= minus_days(as_of, days))


def in_range(df: DataFrame, c: str, low: Column, high: Column) -> DataFrame:
    return df.where(column(c).between(low, high))
