"""Row numbers, batches and per-group samples that do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators.ordered import quantile_slices, running


def row_numbers(df: DataFrame, position: Column, tie: Sequence[str], name: str = "rn", total: str = "n_rows",
                slices: int | None = None) -> DataFrame:
    """Number all rows by a numeric position and tie-breaking columns; also the row count."""
    placed = df.withColumns({"_pos": position, "_one": F.lit(1).cast("long")})
    placed, slice_col = quantile_slices(placed, "_pos", slices)
    order = [F.col("_pos"), *[F.col(c) for c in tie]]
    out = running(placed, [], order, {name: ("sum", "_one")}, slice_col, totals={total: "_one"})
    return out.select(*df.columns, name, total)


def ntile(rn: Column, total: Column, buckets: int) -> Column:
    """Bucket 1..buckets of a row number, earlier buckets one larger when uneven."""
    size, extra = F.floor(total / buckets), total % buckets
    edge = extra * (size + 1)
    late = extra + F.floor((rn - 1 - edge) / F.nullif(size, F.lit(0)))
    return (F.when(rn <= edge, F.floor((rn - 1) / (size + 1))).otherwise(late) + 1).cast("long")


def stratified_sample(df: DataFrame, strata: Sequence[str], key: Sequence[str], n: int, seed: str) -> DataFrame:
    """n rows per stratum, chosen by the md5 of key and seed: the same rows on every run.

    A stratum is thinned to n rows in every input partition first, however many there are,
    so the deciding window holds n rows of a stratum from each of them.
    """
    mark = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(seed)))
    rows = df.withColumn("_mark", mark)
    part = F.spark_partition_id()
    order = [F.col("_mark"), *[F.col(c) for c in key]]
    first = Window.partitionBy(*strata, "_part").orderBy(*order)
    last = Window.partitionBy(*strata).orderBy(*order)
    thinned = rows.withColumn("_part", part).withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= n)
    return thinned.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= n).drop("_mark", "_part", "_r")
