"""Dates, weeks and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKDAYS = ["MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY"]


def expected_dates(start: Column, end: Column, weekday: Column) -> Column:
    """All dates of a weekday (0 is Monday) from start to end, both included; empty if there are none or the weekday is none."""
    first = F.date_add(start, F.pmod(weekday - F.weekday(start), F.lit(7)))
    ok = weekday.between(0, 6) & (first <= end)
    return F.when(ok, F.sequence(first, F.when(ok, end), F.expr("interval 7 days"))).otherwise(F.array().cast("array<date>"))


def weeks_since(start: Column, day: Column) -> Column:
    """Whole weeks from start to day; negative ones round down."""
    return F.floor(F.datediff(day, start) / 7).cast("int")


def monday_week(day: Column) -> Column:
    """Week of the year; days before the first Monday are in week 0."""
    return F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7).cast("int")


def weekday_number(name: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(w) for w in WEEKDAYS]), F.upper(name)) - 1).cast("int")


def is_weekend(weekday: Column) -> Column:
    return weekday >= 5


def as_date(x: Column) -> Column:
    """The day of a date, time or text; null if it is none."""
    return F.try_to_date(x.cast("string").substr(1, 10))


def user_name(name: Column, prefix: str = "IT") -> Column:
    """Lower case without underscores for names that begin with prefix; others stay."""
    return F.when(F.startswith(name, F.lit(prefix)), F.lower(F.replace(name, F.lit("_"), F.lit("")))).otherwise(name)
