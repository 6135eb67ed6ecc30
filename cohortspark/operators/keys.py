"""Row selection and joins by key, with null keys treated as equal where stated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_key(order: Sequence[str | tuple[str, str]]) -> Column:
    """A comparable struct for an ordering with nulls last.

    Items are column names or ``(name, "desc")``; a descending item must be numeric.
    """
    parts = []
    for item in order:
        name, direction = (item, "asc") if isinstance(item, str) else item
        value = F.col(name)
        parts.append(value.isNull().cast("int"))
        parts.append(-value if direction == "desc" else value)
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | tuple[str, str]]) -> DataFrame:
    """The first row of each key in the given total order.

    An aggregate, not a window: each input partition keeps one row per key before the
    shuffle, so a key holding most of the table costs no more than any other.
    """
    rest = [c for c in df.columns if c not in set(keys)]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order_key(order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def natural_join(left: DataFrame, right: DataFrame, how: str = "left", on: Sequence[str] | None = None) -> DataFrame:
    """Join on every shared column (or ``on``), null matching null, keys kept once."""
    keys = list(on) if on is not None else [c for c in left.columns if c in set(right.columns)]
    if not keys:
        raise ValueError("the tables share no column")
    r = right.select(*[F.col(c).alias(f"_r_{c}" if c in keys else c) for c in right.columns])
    condition = None
    for k in keys:
        test = left[k].eqNullSafe(r[f"_r_{k}"])
        condition = test if condition is None else condition & test
    joined = left.join(r, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    shared = [
        (F.coalesce(F.col(k), F.col(f"_r_{k}")) if how in ("full", "outer", "right") else F.col(k)).alias(k)
        for k in keys
    ]
    rest_l = [F.col(c) for c in left.columns if c not in keys]
    rest_r = [F.col(c) for c in right.columns if c not in keys]
    return joined.select(*shared, *rest_l, *rest_r)


def restrict(df: DataFrame, *allowed: DataFrame, key: str = "id") -> DataFrame:
    """Keep rows whose key is in every one of the tables."""
    for table in allowed:
        df = df.join(table.select(key), key, "left_semi")
    return df


def exclude(df: DataFrame, unwanted: DataFrame, key: str = "id") -> DataFrame:
    """Drop rows whose key is in the table; rows with a null key stay."""
    return df.join(unwanted.select(key), key, "left_anti")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fail when a key repeats; the table itself otherwise."""
    repeated = df.groupBy(*keys).count().filter("count > 1").limit(1).count()
    if repeated:
        raise ValueError(f"key {list(keys)} is not unique")
    return df
