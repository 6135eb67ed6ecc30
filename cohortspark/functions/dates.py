"""Ages and dates. A year is 365 days and a life starts on the first of the birth month."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.0


def birth_date(year: Column, month: Column) -> Column:
    return F.make_date(year.cast("int"), month.cast("int"), F.lit(1))


def age_on(date: Column, dob: Column) -> Column:
    return F.datediff(date, dob) / F.lit(DAYS_PER_YEAR)


def date_at(age: Column, dob: Column) -> Column:
    return F.date_add(dob, F.floor(age * F.lit(DAYS_PER_YEAR)).cast("int"))


def days_between(end: Column, start: Column) -> Column:
    return F.datediff(end, start).cast("double")


def parse_day_month_year(text: Column) -> Column:
    """Day-month-year in the separators seen in registry exports; null when unreadable."""
    return F.coalesce(
        F.try_to_date(text, "d/M/yyyy"),
        F.try_to_date(text, "d-M-yyyy"),
        F.try_to_date(text, "d.M.yyyy"),
    )
