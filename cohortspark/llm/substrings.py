"""Removal of repeated passages through a compacted De Bruijn graph of word windows.

The edges of the graph are the windows of ``width`` consecutive words. A window is filed
under its minimiser, the smallest hash among its short word k-mers, so equal windows meet
under the same minimiser. Consecutive windows of a text around one place of a minimiser form a
path; two windows of a path are never equal, as the minimiser stands at different offsets.

* A minimiser with a single path in the whole corpus repeats nothing.
* A minimiser whose paths are all equal does not branch: the path is compacted, and all its
  windows are repeated.
* At a branching minimiser the distinct paths are looked up at their source coordinates and
  unrolled into windows, which are counted.

Only path keys are shuffled (one per 14 windows or so), copies of a path collapse before the
shuffle, and texts are moved twice, by document.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.textops import U64, Words, arrow_limits, column_bytes, each_block, mix, range_hash, signed
from cohortspark.sources.stored import settle

KMER = 8


def _sliding_min(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum of each run of ``width`` values and where it stands first."""
    at = np.arange(len(x), dtype=np.int32)

    def meet(x: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        later = x[step:] < x[: len(x) - step]
        return np.where(later, x[step:], x[: len(x) - step]), np.where(later, at[step:], at[: len(at) - step])

    step = 1
    while 2 * step <= width:
        x, at = meet(x, at, step)
        step *= 2
    return meet(x, at, width - step) if width > step else (x, at)


def _paths(words: Words, width: int) -> tuple[np.ndarray, ...]:
    """(minimiser, content, row, first window, windows) of every path of some rows."""
    first = words.first
    h = words.hashes()
    if len(h) < width:
        return np.zeros(0, U64), np.zeros(0, U64), *(np.zeros(0, np.int64),) * 3
    k = min(KMER, width)
    kmer = np.zeros(len(h) - k + 1, U64)
    for j in range(k):
        kmer = kmer * U64(0x2545F4914F6CDD1D) + h[j : j + len(kmer)]
    low, place = _sliding_min(mix(kmer, 3), width - k + 1)  # of the windows, those across two rows included
    row = np.searchsorted(first, np.arange(len(low)), "right") - 1
    inside = np.arange(len(low)) + width <= first[row + 1]
    new = np.ones(len(low), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    starts = np.flatnonzero(inside & new)
    ends = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True)) + 1
    content = range_hash(h, starts, ends + width - 1)
    return low[starts], content, row[starts], starts - first[row[starts]], ends - starts


def path_rows(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo, hi, words in each_block(batch.column(2)):
                m, c, row, at, n = _paths(words, width)
                anonymous, ids = (batch.column(i).slice(lo, hi - lo).take(pa.array(row)) for i in range(2))
                yield pa.RecordBatch.from_arrays(
                    [signed(m), signed(c), anonymous, ids, pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["m", "c", "anonymous", "id", "at", "n"])

    return docs.select("anonymous", "id", "text").mapInArrow(run, "m long, c long, anonymous boolean, id long, at int, n int")


def _unroll(docs: DataFrame, sources: DataFrame, width: int) -> DataFrame:
    """Windows (m, c, i, window) of the paths whose source coordinates are listed by document."""

    def run(batches):
        for batch in batches:
            places = batch.column(2).to_pylist()
            m, c, i, win = [], [], [], []
            for lo, hi, words in each_block(batch.column(1)):
                h = words.hashes()
                for r in range(lo, hi):
                    base = words.first[r - lo]
                    for p in places[r]:
                        if p["at"] + p["n"] + width - 1 > words.first[r - lo + 1] - base:
                            continue  # another text of the same id
                        at = base + p["at"] + np.arange(p["n"])
                        m.append(np.full(p["n"], p["m"]))
                        c.append(np.full(p["n"], p["c"]))
                        i.append(np.arange(p["n"], dtype=np.int32))
                        win.append(at)
                if win:
                    at = np.concatenate(win)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(m)), pa.array(np.concatenate(c)), pa.array(np.concatenate(i)), signed(range_hash(h, at, at + width))],
                        ["m", "c", "i", "w"])
                    m, c, i, win = [], [], [], []

    listed = sources.groupBy("anonymous", "id").agg(F.collect_list(F.struct("m", "c", "at", "n")).alias("places"))
    return docs.join(listed, ["anonymous", "id"]).select("id", "text", "places").mapInArrow(run, "m long, c long, i int, w long")


def _strip(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Texts without the listed ranges of words."""

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            raw = data.tobytes()
            starts, ends = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            n, gone, text = [], [], []
            for i in range(batch.num_rows):
                words = raw[offsets[i] : offsets[i + 1]].split()
                n.append(len(words))
                if starts[i]:
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, np.minimum(starts[i], len(words)), 1)
                    np.add.at(depth, np.minimum(ends[i], len(words)), -1)
                    keep = np.cumsum(depth[:-1]) == 0
                    words = list(compress(words, keep.tolist()))
                gone.append(n[-1] - len(words))
                text.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())],
                ["id", "n_words", "n_removed", "kept_text"])

    listed = ranges.groupBy("id").agg(F.collect_list("from").alias("starts"), F.collect_list("to").alias("ends"))
    return docs.join(listed, "id", "left").select("id", "text", "starts", "ends").mapInArrow(
        run, "id long, n_words long, n_removed long, kept_text string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35) -> DataFrame:
    """``(id_col, n_words, n_removed, kept_text)``: texts without words of repeated windows.

    A window is ``width`` consecutive words of one text, unchanged; it is repeated when its
    words also start anywhere else, in the same text or another. Windows are judged on the
    input. ``kept_text`` joins the kept words by one space. A null text has no words; a text
    with fewer than ``width`` words keeps all. Ids are unique: a repeated row is an occurrence of
    its own, and loses what another row of its id loses. Windows of rows without an id count,
    but such rows keep all words. Other columns are ignored, an empty table gives an empty
    result.
    """
    arrow_limits(docs.sparkSession)
    text, id_ = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    docs = docs.select(id_.isNull().alias("anonymous"), F.coalesce(id_, F.xxhash64(text)).alias("id"), text.alias("text"))
    paths = path_rows(docs, width)
    per = paths.groupBy("m").agg(F.count("*").alias("size"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("size > 1")
    per = settle(per, "minimisers")  # both sides of the join are plain exchanges then, which Spark can split
    shared = settle(paths.join(per.select("m", (F.col("lo") != F.col("hi")).alias("branching")), "m"), "paths")
    branching = (shared.filter("branching").groupBy("m", "c")
                 .agg(F.count("*").alias("copies"), F.min(F.struct("anonymous", "id", "at", "n")).alias("s")).select("m", "c", "copies", "s.*"))
    branching = settle(branching, "branching")
    windows = settle(_unroll(docs, branching, width), "windows")
    again = windows.groupBy("m", "w").agg(F.count("*").alias("seen")).filter("seen > 1")
    alone = branching.filter("copies = 1 and not anonymous").select("m", "c", "id", "at")  # paths with copies are repeated as they are
    pieces = (windows.join(again, ["m", "w"], "left_semi").select("m", "c", "i").join(alone, ["m", "c"])
              .select("id", (F.col("at") + F.col("i")).alias("from"), (F.col("at") + F.col("i") + width).alias("to")))
    copied = branching.filter("copies > 1").select("m", "c")
    named = shared.filter("not anonymous")
    full = named.filter("not branching").select("id", "at", "n").union(
        named.filter("branching").join(copied, ["m", "c"], "left_semi").select("id", "at", "n"))
    covered = full.select("id", F.col("at").alias("from"), (F.col("at") + F.col("n") + width - 1).alias("to")).union(pieces)
    return _strip(docs.withColumn("id", F.when(~F.col("anonymous"), F.col("id"))), covered).withColumnRenamed("id", id_col)


def digest(kept: DataFrame) -> DataFrame:
    """The texts of :func:`without_repeats` as SHA-256 in lowercase hex."""
    return kept.select(*[c for c in kept.columns if c != "kept_text"], F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))

