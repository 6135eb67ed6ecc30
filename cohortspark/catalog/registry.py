"""The table of named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortspark.catalog import fixtures
from cohortspark.session import tune
from cohortspark.sources.stored import file_bytes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NARROW = ("customer", "supplier", "part")  # a few bytes a row in a file; views make many rows of each
DEALT = 10_000  # of their rows a task
ORACLES: dict[str, str] = {}


class Inputs:
    """Derived input tables by name: ``fx("patient")`` is the DataFrame of that view.

    Only plans are remembered (a file's schema is read once), never rows.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._plans: dict[str, DataFrame] = {}
        self.size = sum(file_bytes(spark, f"{folder}/{name}.parquet") for name in fixtures.SOURCES)

    def __call__(self, name: str) -> DataFrame:
        if name not in self._plans:
            self._plans[name] = fixtures.table(self.spark, name, self.source)
        return self._plans[name]

    def source(self, name: str) -> DataFrame:
        key = f"source {name}"
        if key not in self._plans:
            table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            if name in NARROW:  # one task reads a row group of a million: deal them out before they are unpacked
                least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
                table = table.repartition(max(least, -(-table.count() // DEALT)))
            self._plans[key] = table
        return self._plans[key]


_OPEN: dict[str, Inputs] = {}


def _inputs(spark: SparkSession, folder: str) -> Inputs:
    """One set of plans per folder, of the session in use."""
    found = _OPEN.get(folder)
    if found is None or found.spark is not spark:
        if found is not None:
            _OPEN.clear()  # plans of a session that is gone
        found = _OPEN[folder] = Inputs(spark, folder)
    return found


def query(name: str, sql: str | None = None):
    """Register ``fn(fx) -> DataFrame``; ``sql`` may name the derived views it reads."""

    def add(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            fx = _inputs(spark, folder)
            tune(spark, fx.size)
            return fn(fx)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = fixtures.with_views(sql)
        return fn

    return add
