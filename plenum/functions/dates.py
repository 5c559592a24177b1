"""Date functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def long_date(day: Column) -> Column:
    """Jun 25, 2026"""
    return F.date_format(day, "MMM d, yyyy")


def month_short(day: Column) -> Column:
    return F.upper(F.date_format(day, "MMM"))


def date_range(start: Column, end: Column) -> Column:
    """Two days without repeating a month or a year that they share; one day alone where they are equal."""
    same_year = F.year(start) == F.year(end)
    first = F.when(same_year, F.date_format(start, "MMM d")).otherwise(long_date(start))
    last = F.when(same_year & (F.month(start) == F.month(end)), F.date_format(end, "d, yyyy")).otherwise(long_date(end))
    return F.when(start == end, long_date(start)).otherwise(F.concat(first, F.lit(" – "), last))


def days_inclusive(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def in_zone(at: Column, hours: Column) -> Column:
    """A UTC timestamp moved by a fixed number of hours (no summer time)."""
    return at + F.make_dt_interval(hours=hours)


def overlaps(start: Column, end: Column, since: Column, until: Column) -> Column:
    """Whether the periods meet; what isn't known passes."""
    return ~F.coalesce(end < since, F.lit(False)) & ~F.coalesce(start > until, F.lit(False))
