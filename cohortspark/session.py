"""Session settings and the shared scratch location."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even when that costs the shuffle its parent could have saved
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

ESTIMATED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
TASK, TASK_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m"  # as shuffled; sorted and hashed it is some thirty times that
PARTITIONS, FIRST, PIECE = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum", 2 << 20
LISTED = "32k"  # an estimate below it is a list of values, or a table that stays small when it is unpacked


def _bytes(text: str) -> int:
    """A size as Spark writes it: ``8m``, ``64MB``, or bytes."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([bkmgtp]?)b?\s*", text.lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit or "b")


def tune(spark: SparkSession, size: int = 0) -> SparkSession:
    """Apply the runtime settings every plan in this package relies on.

    Memory stays with the cluster. So does the number of shuffle partitions, but as the least
    one: a task's memory must not grow with the tables, so ``size`` bytes of input files are
    dealt to a partition for each 2 MB, and AQE merges what is small, up to 8 MB or what the
    session asks for, if that is less. The session's limit for broadcasts is kept, but for measured sizes: estimates are those of
    compressed files and count an exploded row once, so a table of a gigabyte looks small.
    """
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    if _bytes(spark.conf.get(TASK, None) or TASK_BYTES) >= _bytes(TASK_BYTES):
        spark.conf.set(TASK, TASK_BYTES)
    spark.conf.set(FIRST, max(int(spark.conf.get(PARTITIONS)), -(-size // PIECE)))
    limit = spark.conf.get(ESTIMATED)
    if spark.conf.get(MEASURED, None) is None:
        spark.conf.set(MEASURED, limit)
    if not limit.startswith("-"):  # no broadcasts at all
        spark.conf.set(ESTIMATED, LISTED)
    return spark


def arrow_bytes(spark: SparkSession, limit: int = 64 << 20) -> None:
    """Bound Arrow batches by bytes: rows that hold matrices are few and large."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path for a written intermediate, below the folder the cluster shares.

    Read from ``spark.checkpoint.dir``. Only a local-mode session may go without it; there a
    temporary folder is made once and remembered in the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster is a cluster
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = spark.conf.get("cohortspark.local.scratch", None)
        if not root:
            root = tempfile.mkdtemp(prefix="cohortspark-")
            spark.conf.set("cohortspark.local.scratch", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

