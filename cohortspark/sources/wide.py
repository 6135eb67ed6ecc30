"""The wide raw participant table: columns named ``<name>_f<field>_<instance>_<array>``.

Column names are read at plan time, so picking fields costs no pass over the data, and
arrays that belong together are paired by name instead of by a join.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAW_NAME = re.compile(r"^(?P<name>.+)_f(?P<field>\d+)_(?P<instance>\d+)_(?P<arr>\d+)$")


class RawColumn(NamedTuple):
    column: str
    field: int
    instance: int
    arr: int


def raw_columns(df: DataFrame, fields: Iterable[int] | None = None) -> list[RawColumn]:
    wanted = None if fields is None else {int(f) for f in fields}
    found = []
    for c in df.columns:
        m = RAW_NAME.match(c)
        if m and (wanted is None or int(m["field"]) in wanted):
            found.append(RawColumn(c, int(m["field"]), int(m["instance"]), int(m["arr"])))
    return found


def load_exclude(raw: DataFrame, withdrawn: DataFrame, key: str = "eid") -> DataFrame:
    """Rows of participants who are not on the withdrawal list (its first column)."""
    ids = withdrawn.select(F.col(withdrawn.columns[0]).alias(key))
    return raw.join(ids, key, "left_anti")


def _rows(df: DataFrame, key: str, structs: list[Column], schema_names: list[str]) -> DataFrame:
    if not structs:
        raise ValueError("no raw column matches")
    return df.select(F.col(key).alias("id"), F.inline(F.array(*structs))).select("id", *schema_names)


def long_fields(df: DataFrame, fields: Iterable[int], key: str = "eid") -> DataFrame:
    """id, field, feature_name, timepoint, arr, value (text) for the non-null cells."""
    structs = [
        F.struct(
            F.lit(c.field).alias("field"),
            F.lit(c.column).alias("feature_name"),
            F.lit(c.instance).alias("timepoint"),
            F.lit(c.arr).alias("arr"),
            F.col(c.column).cast("string").alias("value"),
        )
        for c in raw_columns(df, fields)
    ]
    names = ["field", "feature_name", "timepoint", "arr", "value"]
    return _rows(df, key, structs, names).filter(F.col("value").isNotNull())


def paired_fields(
    df: DataFrame, field: int, partner: int, names: tuple[str, str], types: tuple[str, str], key: str = "eid"
) -> DataFrame:
    """id, instance, arr and the two values of arrays that share instance and position."""
    partners = {(c.instance, c.arr): c.column for c in raw_columns(df, [partner])}
    structs = []
    for c in raw_columns(df, [field]):
        other = partners.get((c.instance, c.arr))
        second = F.col(other) if other else F.lit(None)
        structs.append(
            F.struct(
                F.lit(c.instance).alias("instance"),
                F.lit(c.arr).alias("arr"),
                F.col(c.column).cast(types[0]).alias(names[0]),
                second.cast(types[1]).alias(names[1]),
            )
        )
    return _rows(df, key, structs, ["instance", "arr", *names]).filter(F.col(names[0]).isNotNull())


def first_occurrences(df: DataFrame, code_names: DataFrame, key: str = "eid") -> DataFrame:
    """id, icd, date, meaning from per-code columns named ``date_<three-character code>...``.

    Only codes that occur in the ICD-10 name table (coding, meaning) count.
    """
    structs = []
    for c in df.columns:
        m = re.match(r"^date_([a-z]\d\d)_", c)
        if m:
            structs.append(F.struct(F.lit(m[1].upper()).alias("icd"), F.col(c).cast("date").alias("date")))
    events = _rows(df, key, structs, ["icd", "date"]).filter(F.col("date").isNotNull())
    majors = code_names.groupBy(F.substring("coding", 1, 3).alias("icd")).agg(
        F.max(F.when(F.length("coding") == 3, F.col("meaning"))).alias("meaning")
    )
    return events.join(majors, "icd").select("id", "icd", "date", "meaning")


def row_min(df: DataFrame, fields: Iterable[int], sentinels: Iterable[float] | None = None) -> Column:
    """Smallest non-null value over every instance and position of the fields.

    ``sentinels`` are answer codes to treat as missing; by default they count as values.
    """
    cols = []
    for c in raw_columns(df, fields):
        v = F.col(c.column).cast("double")
        if sentinels is not None:
            v = F.when(~v.isin(*sentinels), v)
        cols.append(v)
    if not cols:
        return F.lit(None).cast("double")
    return F.least(*cols) if len(cols) > 1 else cols[0]
