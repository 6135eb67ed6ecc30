"""Column helpers for missing values that propagate instead of falling through."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ifelse(condition: Column, yes, no) -> Column:
    """``yes`` or ``no`` by condition, and null where the condition itself is null."""
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(condition, yes).when(~condition, no)


def blank_to_null(column: Column) -> Column:
    return F.when(F.trim(column) != "", column)


def mean_strict(column: Column) -> Column:
    """Mean that is null as soon as one value is null."""
    return F.when(F.count(column) == F.count(F.lit(1)), F.avg(column))


def rounded(column: Column, digits: int = 6) -> Column:
    """Round for display; adding zero turns -0.0 into 0.0."""
    return F.round(column, digits) + F.lit(0.0)
