"""Connected components by alternating stars; vertices and links stay in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.sources.stored import last_written, lifetime, settle


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` point from larger to smaller ids."""
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    return links.join(low, "u").select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``(id, component)`` of every vertex that has a link; the component is its smallest id.

    Each half round writes its links below the shared folder, and the end its result: lineage and
    the driver's plans stay short. Every vertex's smallest neighbour is found by an aggregate with
    partial minima, so a hub costs its own task nothing. Raises when ``rounds`` do not suffice
    (they double the reach).
    """
    spark = links.sparkSession
    links = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = settle(links, "links")
    state = _state(links)
    for _ in range(rounds):
        if not state[0]:
            break
        with lifetime(spark) as keep:
            links = settle(_small_star(settle(_large_star(links), "halves")), "links")
            keep.append(last_written(spark))
        after = _state(links)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("components did not settle")
    tops = links.select(F.col("v").alias("id")).distinct()
    return settle(links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        tops.select("id", F.col("id").alias("component"))), "parts")
