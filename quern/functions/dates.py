"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def completed_months(start: Column, end: Column) -> Column:
    """Whole calendar months from start to end: a month counts once its day of the month is reached. Null if end is before start."""
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) - (F.day(end) < F.day(start)).cast("int")
    return F.when(end >= start, months.cast("long"))


def in_window(day: Column, start: Column, end: Column) -> Column:
    """Whether a day is within an inclusive window that may be open at one end; false if open at both, or for a null day."""
    some = start.isNotNull() | end.isNotNull()
    inside = (start.isNull() | (day >= start)) & (end.isNull() | (day <= end))
    return F.coalesce(some & inside & day.isNotNull(), F.lit(False))


def effective_date(*days: Column) -> Column:
    """The earliest of several dates, nulls skipped."""
    return F.least(*days)
