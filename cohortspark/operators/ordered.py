"""Running aggregates and ranks over groups of any size.

A plain window sends each group to one task. Here a group is first cut into slices that
follow its order; the window runs inside a slice, and the much smaller table of slice
totals supplies what came before. There is one path at every size: callers whose groups are
bounded by their nature (the times of a curve) ask for one slice, all others get as many as
the session has shuffle partitions.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.sources.stored import settle

BOUNDED = 1  # slices of a table whose groups are small whatever the size of the data


def quantile_slices(
    df: DataFrame, column: str, slices: int | None = None, rows: DataFrame | None = None
) -> tuple[DataFrame, str | None]:
    """Add a slice number that grows with ``column``, from approximate quantiles of the table.

    The cut points come from one aggregate over ``rows`` (the table itself, or what it was
    counted from, which saves its shuffle) and are fixed numbers in the plan: an executor
    that recomputes its part assigns the same slices, and nothing is written. Equal values
    share a slice.
    """
    return sliced(df, column, cut_points(df if rows is None else rows, column, slices))


def cut_points(rows: DataFrame, column: str, slices: int | None = None) -> list[float]:
    """Finite, distinct values that cut the column into about equal parts (one aggregate)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) if slices is None else slices
    if n <= 1:
        return []
    probs = [i / n for i in range(1, n)]
    found = rows.select(F.percentile_approx(F.col(column).cast("double"), probs, max(10_000, 4 * n)).alias("q")).first()["q"]
    return sorted({c for c in found or [] if math.isfinite(c)})


def sliced(df: DataFrame, column: str, cuts: Sequence[float]) -> tuple[DataFrame, str | None]:
    """Add the slice of each row for given cut points."""
    if not cuts:
        return df, None
    cutter = Bucketizer(
        splits=[-math.inf, *cuts, math.inf], inputCol="_cut", outputCol="_slice", handleInvalid="keep"
    )
    return cutter.transform(df.withColumn("_cut", F.col(column).cast("double"))).drop("_cut"), "_slice"


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[f"{prefix}{k}"])
    return condition


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    values: Mapping[str, tuple[str, str]],
    slice_col: str | None = None,
    before: bool = False,
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Running ``sum``, ``max`` or ``last`` (non-null) per group.

    ``values`` maps an output name to ``(kind, column)``. ``before`` leaves the current row
    out. ``totals`` maps output names to columns summed over the whole group.
    """
    totals = dict(totals or {})
    sliced = slice_col is not None
    inner_keys = [*keys, slice_col] if sliced else list(keys)
    w = Window.partitionBy(*inner_keys).orderBy(*order)
    w = w.rowsBetween(Window.unboundedPreceding, -1 if before else 0)

    def over(kind: str, column: str, window) -> Column:
        if kind == "sum":
            return F.sum(column).over(window)
        if kind == "max":
            return F.max(column).over(window)
        if kind == "last":
            return F.last(column, ignorenulls=True).over(window)
        raise ValueError(kind)

    out = df.select("*", *[over(kind, c, w).alias(name) for name, (kind, c) in values.items()])
    if not sliced:
        whole = Window.partitionBy(*keys)
        for name, c in totals.items():
            out = out.withColumn(name, F.sum(c).over(whole))
        zero = {n: F.coalesce(F.col(n), F.lit(0)) for n, (kind, _) in values.items() if kind == "sum"}
        return out.withColumns(zero) if zero else out

    # one row per (group, slice): what the slice adds to the groups after it
    adds = []
    for name, (kind, c) in values.items():
        if kind == "sum":
            adds.append(F.sum(c).alias(name))
        elif kind == "max":
            adds.append(F.max(c).alias(name))
        else:
            position = F.when(F.col(c).isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(_plain(order))]))
            adds.append(F.max_by(c, position).alias(name))
    adds += [F.sum(c).alias(name) for name, c in totals.items()]
    per_slice = df.groupBy(*inner_keys).agg(*adds)
    prior = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carry = per_slice.select(
        *[F.col(k).alias(f"_c_{k}") for k in inner_keys],
        *[over(kind, name, prior).alias(f"_c_{name}") for name, (kind, _) in values.items()],
        *[F.sum(name).over(whole).alias(name) for name in totals],
    )
    joined = out.join(carry, _match(out, carry, inner_keys, "_c_"), "left")
    final = {}
    for name, (kind, _) in values.items():
        mine, came = F.col(name), F.col(f"_c_{name}")
        if kind == "sum":
            final[name] = F.coalesce(mine, F.lit(0)) + F.coalesce(came, F.lit(0))
        elif kind == "max":
            final[name] = F.greatest(mine, came)
        else:
            final[name] = F.coalesce(mine, came)
    return joined.withColumns(final).select(*df.columns, *values, *totals)


def _plain(order: Sequence[Column]) -> list[Column]:
    """Ordering columns as values; callers order by ascending names when they use ``last``."""
    return [F.col(o) if isinstance(o, str) else o for o in order]


def ranked(
    df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None, slices: int | None = None
) -> DataFrame:
    """Distinct (keys, value) with ``n`` rows, ``upto`` rows at or below and ``total`` rows.

    Rows are counted before the shuffle; ``weight`` counts only part of them (0/1 or a
    number) into ``w``, ``w_upto`` and ``w_total``. Null values are left out.
    """
    w = F.sum(weight) if weight else F.count(F.lit(1))
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n"), w.alias("w"))
    )
    counts, slice_col = quantile_slices(counts, value, slices, df)
    return running(
        counts,
        keys,
        [F.col(value)],
        {"upto": ("sum", "n"), "w_upto": ("sum", "w")},
        slice_col=slice_col,
        totals={"total": "n", "w_total": "w"},
    ).drop("_slice")


def with_ranks(
    df: DataFrame, keys: Sequence[str], value: str, outputs: Mapping[str, Column],
    weight: str | None = None, slices: int | None = None,
) -> DataFrame:
    """Attach expressions over the rank columns (n, upto, total, w, w_upto, w_total).

    Rows with a null value get nulls. The table is written once and ranked in slices;
    ``slices=1`` takes a single window, for groups that are known to be small.
    """
    if slices != BOUNDED:
        return _sliced_ranks(df, keys, value, outputs, weight, slices)
    known = F.col(value).isNotNull()
    group = Window.partitionBy(*keys, known)
    order = group.orderBy(value)
    upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    peers = order.rangeBetween(Window.currentRow, Window.currentRow)
    one = F.lit(1).cast("long")
    mass = F.col(weight) if weight else one
    ranks = {
        "n": F.count(one).over(peers), "upto": F.count(one).over(upto), "total": F.count(one).over(group),
        "w": F.sum(mass).over(peers), "w_upto": F.sum(mass).over(upto), "w_total": F.sum(mass).over(group),
    }
    taken = set(ranks) & set(df.columns)
    if taken:
        raise ValueError(f"rename columns {sorted(taken)}")
    rows = df.withColumns(ranks)
    return rows.select(*df.columns, *[F.when(known, e).alias(n) for n, e in outputs.items()])


def _sliced_ranks(df: DataFrame, keys: Sequence[str], value: str, outputs: Mapping[str, Column], weight: str | None, slices: int | None) -> DataFrame:
    """Ranks inside slices plus what earlier slices hold; no join on values.

    A value that fills a slice by itself has one of its own: all its rows rank alike, so they
    take the slice's totals and need not meet in a task.
    """
    taken = {"n", "upto", "total", "w", "w_upto", "w_total"} & set(df.columns)
    if taken:
        raise ValueError(f"rename columns {sorted(taken)}")
    spark = df.sparkSession
    rows = settle(df, "ranked")
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) if slices is None else slices
    x = F.col(value).cast("double")
    found = rows.select(F.percentile_approx(x, [i / n for i in range(1, n)], max(10_000, 4 * n)).alias("q")).first()["q"] or []
    found = [c for c in found if math.isfinite(c)]
    alone = sorted({a for a, b in zip(found, found[1:]) if a == b})
    splits = sorted({-math.inf, math.inf, *found, *[math.nextafter(a, math.inf) for a in alone]})
    cutter = Bucketizer(splits=splits, inputCol="_x", outputCol="_slice", handleInvalid="keep")
    sliced = cutter.transform(rows.withColumn("_x", x)).drop("_x")
    whole = F.col(value).isNull() | F.col("_slice").isin([float(splits.index(a)) for a in alone])
    mass = F.col(weight) if weight else F.lit(1).cast("long")

    per_slice = sliced.filter(F.col(value).isNotNull()).groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"), F.sum(mass).alias("_w"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_slice.select(
        *[F.col(k).alias(f"_c_{k}") for k in [*keys, "_slice"]], "_n", "_w",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_w")],
        *[F.sum(c).over(group).alias(f"{c}_total") for c in ("_n", "_w")])
    carry = settle(carry, "slices")  # a row a group and slice: its size is known when its join is planned
    salt = F.when(whole, F.spark_partition_id()).otherwise(-1)
    order = Window.partitionBy(*keys, "_slice", "_salt").orderBy(value)
    upto, peers = order.rangeBetween(Window.unboundedPreceding, Window.currentRow), order.rangeBetween(Window.currentRow, Window.currentRow)
    one = F.lit(1).cast("long")
    inside = sliced.withColumn("_salt", salt).select(
        "*", F.count(one).over(peers).alias("_n_at"), F.count(one).over(upto).alias("_n_upto"), F.sum(mass).over(peers).alias("_w_at"), F.sum(mass).over(upto).alias("_w_upto"))
    joined = inside.join(carry, _match(inside, carry, [*keys, "_slice"], "_c_"), "left")
    pick = lambda all_, own: F.when(whole, F.col(all_)).otherwise(F.col(own))
    ranks = {
        "n": pick("_n", "_n_at"), "upto": F.col("_n_before") + pick("_n", "_n_upto"), "total": F.col("_n_total"),
        "w": pick("_w", "_w_at"), "w_upto": F.col("_w_before") + F.coalesce(pick("_w", "_w_upto"), F.lit(0)), "w_total": F.col("_w_total"),
    }
    known = F.col(value).isNotNull()
    return joined.withColumns(ranks).select(*df.columns, *[F.when(known, e).alias(name) for name, e in outputs.items()])


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], slices: int | None = None) -> DataFrame:
    """Exact interpolated quantiles (R type 7) per group: keys, n, p, value.

    Read off the running counts, so no group is gathered in one place.
    """
    ranks = ranked(df, keys, value, slices=slices)
    first = F.col("upto") - F.col("n")  # rows strictly below this value
    picks = []
    for i, p in enumerate(probs):
        at = (F.col("total") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(at) + 1), ("hi", F.ceil(at) + 1)):
            picks.append(F.max(F.when((first < rank) & (rank <= F.col("upto")), F.col(value))).alias(f"_{side}{i}"))
    wide = ranks.groupBy(*keys).agg(F.max("total").alias("n"), *picks)
    rows = []
    for i, p in enumerate(probs):
        at = (F.col("n") - 1) * F.lit(float(p))
        x = F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (at - F.floor(at))
        rows.append(F.struct(F.lit(float(p)).alias("p"), x.alias(value)))
    return wide.select(*keys, "n", F.inline(F.array(*rows)))


def rolling_mean(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, output: str, width: int = 2) -> DataFrame:
    """Mean of each full run of ``width`` neighbouring rows, as at its first row; null at the end."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, width - 1)
    full = F.count(F.lit(1)).over(w) == width
    return df.withColumn(output, F.when(full, F.avg(value).over(w)))
