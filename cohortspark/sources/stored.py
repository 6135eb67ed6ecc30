"""Written intermediates: reuse when complete, else write and read back, and drop in the end."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from cohortspark.session import scratch_dir

_written: dict[str, list[str]] = {}  # paths below the scratch folder, by application
_reusable: dict[tuple[str, str, str], str] = {}
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def file_bytes(spark: SparkSession, path: str) -> int:
    """Length of a file, or of all files below a folder; 0 where there is none."""
    files, hadoop = _file_system(spark, path)
    return files.getContentSummary(hadoop).getLength() if files.exists(hadoop) else 0


def _complete(spark: SparkSession, path: str) -> bool:
    files, marker = _file_system(spark, f"{path}/_SUCCESS")
    return files.exists(marker)


def materialize(spark: SparkSession, build: Callable[[], DataFrame], path: str) -> DataFrame:
    """The table at ``path``; built and written only when no finished copy is there.

    An unfinished copy (no success marker) is overwritten.
    """
    if not _complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several later jobs read, and read it back: lineage ends here.

    Its shuffle files go with the write; else they lie on the executors' disks until the driver
    collects garbage. Fails on a cluster without a shared folder (see :func:`scratch_dir`).
    """
    return settle_parts([df], name)


def settle_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """The union of tables, settled one after another: no two have shuffle files at a time."""
    path = None
    for df in parts:
        spark = df.sparkSession
        if path is None:
            path = scratch_dir(spark, name)
            _written.setdefault(spark.sparkContext.applicationId, []).append(path)
        before = spark.conf.get(CLEANED, "false")
        spark.conf.set(CLEANED, "true")
        try:
            df.write.mode("append").parquet(path)
        finally:
            spark.conf.set(CLEANED, before)
    return spark.read.parquet(path)


def last_written(spark: SparkSession) -> str:
    """The path of the table that was settled last."""
    return _written[spark.sparkContext.applicationId][-1]


def _content(df: DataFrame) -> str:
    """A key of what a table will hold: its plan, and the size and time of the files it reads."""
    spark, parts = df.sparkSession, [str(df.semanticHash())]
    for name in sorted(df.inputFiles()):
        files, path = _file_system(spark, name)
        state = files.getFileStatus(path)
        parts.append(f"{name} {state.getLen()} {state.getModificationTime()}")
    return hashlib.md5("\n".join(parts).encode()).hexdigest()


def reuse(df: DataFrame, name: str) -> DataFrame:
    """The written form of a table: an earlier one of equal content in this application, else a new one.

    It lives until the ``lifetime`` it was written in ends, or ``release``.
    """
    spark = df.sparkSession
    key = spark.sparkContext.applicationId, name, _content(df)
    if key not in _reusable or not _complete(spark, _reusable[key]):
        before = len(_written.get(key[0], ()))
        settle(df, name)
        _reusable[key] = _written[key[0]][before]
    return spark.read.parquet(_reusable[key])


def _drop(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        files, hadoop = _file_system(spark, path)
        files.delete(hadoop, True)
    gone = set(paths)
    for key in [k for k, p in _reusable.items() if p in gone]:
        del _reusable[key]


@contextmanager
def lifetime(spark: SparkSession) -> Iterator[list[str]]:
    """Drop at the end what was written inside, except for paths put into the yielded list.

    For results that are complete by then: a plan that still reads a dropped table fails.
    """
    mine = _written.setdefault(spark.sparkContext.applicationId, [])
    start, keep = len(mine), []
    try:
        yield keep
    finally:
        inside, mine[start:] = mine[start:], keep
        _drop(spark, [p for p in inside if p not in keep])


def release(spark: SparkSession) -> None:
    """Drop everything this application has written below its scratch folder."""
    _drop(spark, _written.pop(spark.sparkContext.applicationId, []))
