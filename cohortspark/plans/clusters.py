"""Assignment of patients to given cluster centres and the tables made from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.nulls import mean_strict

CHUNK = 1000  # centres compared at a time: the bound of one array


def nearest_centroid(df: DataFrame, centres: DataFrame, coordinates: Sequence[str], label: str = "clust") -> DataFrame:
    """Add the nearest centre's label, the lowest of equally near ones.

    Missing coordinates are left out and the squared distance is scaled up to all of them. The
    centres become one array per chunk, a scalar subquery, so the table itself is not shuffled;
    more centres take more chunks.
    """
    present = sum((F.col(c).isNotNull().cast("int") for c in coordinates), F.lit(0))
    chunks = -(-max(1, centres.count()) // CHUNK)
    names = [f"c{i}" for i in range(len(coordinates))]
    listed = centres.select(F.col(label).alias("label"), *[F.col(c).cast("double").alias(n) for c, n in zip(coordinates, names)])

    def distance(centre: Column) -> Column:
        total = F.lit(0.0)
        for c, n in zip(coordinates, names):
            d = F.col(c) - centre[n]
            total = total + F.coalesce(d * d, F.lit(0.0))
        return total

    best, out = None, df
    for k in range(chunks):
        part = listed.filter(F.pmod(F.xxhash64("label"), F.lit(chunks)) == k) if chunks > 1 else listed
        chunk = part.agg(F.collect_list(F.struct("label", *names)).alias("centres"))
        out = out.withColumn(f"_centres{k}", chunk.scalar())
        near = F.array_min(F.transform(f"_centres{k}", lambda c: F.struct(distance(c).alias("d"), c["label"].alias("label"))))
        best = near if best is None else F.least(best, near)
    # the scale is the same for every centre and cannot change which one is nearest
    scale = F.lit(float(len(coordinates))) / F.when(present > 0, present)
    return out.withColumn("_best", F.when(present > 0, best)).withColumns({
        label: F.col("_best.label"), "dist": F.sqrt(F.col("_best.d") * scale)}).select(*df.columns, label, "dist")


def profile(assigned: DataFrame, scores: Sequence[str], label: str = "clust") -> DataFrame:
    """Per cluster: n, percent of all, mean of each score, a size label such as 12k."""
    agg = assigned.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in scores])
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())  # one row per cluster
    size = F.when(F.col("n") > 10000, F.concat(F.bround(F.col("n") / 1000).cast("long").cast("string"), F.lit("k")))
    with_share = agg.withColumn("p", share)
    title = F.concat(
        F.coalesce(size, F.col("n").cast("string")), F.lit(" ("), F.bround("p").cast("long").cast("string"), F.lit("%)"))
    return with_share.withColumn("title", title)


def survival_chance(assigned: DataFrame, risks: DataFrame, label: str = "clust") -> DataFrame:
    """Rounded mean percent of surviving per cluster; null when a member has no risk.

    Members without a cluster form a group of their own. Halves go to the even percent, so
    the noise of summing is rounded away before.
    """
    joined = assigned.select("id", "age", label).distinct().join(risks.select("id", "age", "risk"), ["id", "age"], "full")
    return joined.groupBy(label).agg(F.bround(F.round(mean_strict(1 - F.col("risk")) * 100, 9)).alias("risk"))


def regroup(assigned: DataFrame, merged: Mapping[str, tuple[int, int]], keep: Sequence[int], label: str = "clust") -> DataFrame:
    """Keep some clusters and merge label ranges (both ends included) under a new name."""
    name = F.when(F.lit(False), F.lit(""))
    for text, (lo, hi) in merged.items():
        name = name.when(F.col(label).between(lo, hi), F.lit(text))
    name = name.when(F.col(label).isin(list(keep)), F.col(label).cast("string"))
    return assigned.withColumn(label, name).filter(F.col(label).isNotNull())


CHILD_MERGED = {"10-14": (10, 14)}  # fixed values: the groups compared for survival
CHILD_KEPT = (1, 3, 15)


def child_groups(assigned: DataFrame, label: str = "clust") -> DataFrame:
    return regroup(assigned.select("id", label).distinct(), CHILD_MERGED, CHILD_KEPT, label)
