"""Labels of days, ISO weeks and months from lenient date strings. Only ASCII digits count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIODS = ("day", "week", "month")


def period_of(col: Column, period: str) -> Column:
    """The label of the date that a string starts with, or null.

    month needs dddd-dd and day dddd-dd-dd, neither asks the calendar (2024-13 passes); week needs a real date and gives
    its ISO year and week. Spaces round the string do not count.
    """
    if period not in PERIODS:
        raise ValueError(f"period is one of {PERIODS}")
    s = F.trim(col)
    if period == "month":
        return F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}"), F.substring(s, 1, 7))
    day = F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(s, 1, 10))
    if period == "day":
        return day
    d = day.try_cast("date")
    return F.when(d.isNotNull(), F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), d), F.weekofyear(d)))


def date_sort_key(col: Column) -> Column:
    """The trimmed string where it starts like a month, else null; sorts by its characters."""
    s = F.trim(col)
    return F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}"), s)
