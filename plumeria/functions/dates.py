"""Date and time expressions. ``as_of`` is always passed in, never read from a clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts(value: str) -> Column:
    """A timestamp literal without zone, as Parquet timestamps arrive."""
    return F.lit(value).cast("timestamp_ntz")


def plus_days(c: str | Column, days: int) -> Column:
    """Shift a timestamp by whole days, keeping its time of day."""
    return column(c) + F.expr(f"INTERVAL {days} DAYS")


def minus_days(c: str | Column, days: int) -> Column:
    return column(c) - F.expr(f"INTERVAL {days} DAYS")


def cycle_count(start: str | Column, as_of: str | Column) -> Column:
    """Whole days from ``start`` to ``as_of``."""
    return F.date_diff(column(as_of), column(start))


def evaluation_end(as_of: str | Column, weeks_back: int = 0) -> Column:
    """End of the evaluation range: ``as_of`` or a number of weeks before it."""
    return minus_days(as_of, 7 * weeks_back)


def acted_within(start: str | Column, moment: str | Column, days: int = 2) -> Column:
    """1 when ``moment`` lies in ``[start, start + days]``, else 0, null included."""
    begin = column(start)
    return F.when(column(moment).between(begin, plus_days(begin, days)), 1).otherwise(0)


def bin_end(c: str | Column, freq: str) -> Column:
    """Label of the calendar bin of a date: day, Sunday, month end or year end."""
    day = F.to_date(column(c))
    if freq == "D":
        return day
    if freq == "W":
        return F.next_day(F.date_sub(day, 1), "SUN")
    if freq == "M":
        return F.last_day(day)
    if freq == "Y":
        return F.make_date(F.year(day), F.lit(12), F.lit(31))
    raise ValueError(f"unknown frequency {freq!r}")


def parses_as_day(c: str | Column) -> Column:
    """True when the text is a ``year-month-day`` date, padded or not."""
    text = column(c)
    return text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & F.try_to_timestamp(text, F.lit("yyyy-M-d")).isNotNull()
