"""Approximate nearest neighbours by inner product, with an adaptive dimension scan.

Vectors are filed in lists around centres, and every list is stored in blocks: rotated
vectors by columns, so that a few leading dimensions of all of them lie together. Under a
random rotation the partial product over d of D dimensions estimates d/D of the whole one,
with a spread that the two lengths bound; a candidate is abandoned as soon as a test at
``DEVIATIONS`` says that it cannot reach the query's current k-th product. Survivors get the
next block of dimensions, and those left at the end the exact product of the vectors as given.

The rotation is random; centres, the number of lists each query visits and its first bound
(which enough vectors in those lists reach) come from a bounded sample. Every vector is filed. Equal vectors are one entry that answers
with its members in order of id, and equal queries are one search.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.textops import arrow_limits
from cohortspark.sources.stored import settle

SAMPLE_ROWS = 20_000  # vectors that centres, visits and first bounds are fitted on, of each length;
SAMPLE_BYTES = 32 << 20  # fewer where vectors are long
TRIALS = 256  # of them, as queries whose recall sets the number of visits
RECALL = 0.98  # aimed at on the sample
BLOCK_ROWS = 1024
QUERY_ROWS = 256
WIDTH = 16  # dimensions of a column block
DEVIATIONS = 4.0
SLACK = 1e-9  # rounding of the rotation, relative to both lengths


class Index(NamedTuple):
    """What is fitted for vectors of one length."""

    rotation: np.ndarray
    centres: np.ndarray  # unit rows
    visits: int
    sizes: np.ndarray  # rows of the sample in each list
    pivots: np.ndarray
    pivot_lists: np.ndarray


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _centres(m: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of unit rows."""
    centres = m[rng.choice(len(m), n, replace=False)]
    for _ in range(rounds):
        near = np.argmax(m @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, m)
        empty = np.abs(sums).max(axis=1) == 0
        sums[empty] = m[rng.choice(len(m), int(empty.sum()))]
        centres = _unit(sums)
    return centres


def _fit(sample: np.ndarray, lists: int, k: int) -> Index:
    """Centres, and the fewest visits that find RECALL of the sample's own neighbours."""
    rng = np.random.default_rng(7)
    d = sample.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    unit = _unit(sample)
    n = max(1, min(lists, len(sample) // 16))
    centres = _centres(unit, n, rng)
    of = np.argmax(unit @ centres.T, axis=1)
    trial = rng.choice(len(sample), min(TRIALS, len(sample)), replace=False)
    products = sample[trial] @ sample.T
    products[np.arange(len(trial)), trial] = -np.inf
    best = np.argsort(-products, axis=1)[:, : min(k, len(sample) - 1)]
    order = np.argsort(-(unit[trial] @ centres.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n)[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, of[best], axis=1).ravel()) + 1
    visits = int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))]) if len(needed) else 1
    pivots = rng.choice(len(sample), len(sample) // 5, replace=False)
    return Index(rotation, centres, visits, np.bincount(of, minlength=n), sample[pivots], of[pivots])


def _classes(df: DataFrame, id_col: str, vec_col: str, is_query) -> tuple[DataFrame, DataFrame]:
    """Usable rows (id, key) and their distinct vectors (key, d, v, low, asked)."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(finite & F.exists("v", lambda x: x != 0))
    key = F.sha2(F.to_binary(F.concat_ws(",", F.col("v").cast("array<string>")), F.lit("utf-8")), 256)
    rows = rows.groupBy("id").agg(F.min(F.struct(key.alias("key"), F.col("v"))).alias("r")).select("id", "r.key", "r.v")
    rows = settle(rows, "vectors")
    same = rows.groupBy("key").agg(F.min("id").alias("low"), F.max(is_query(F.col("id"))).alias("asked"), F.first("v").alias("v"))
    return rows.select("id", "key"), settle(same.withColumn("d", F.size("v")), "classes")


def _indexes(classes: DataFrame, lists: int, k: int) -> dict[int, Index]:
    """An index of each length, from a sample of bounded size (the smallest keys, which are hashes)."""
    out = {}
    for (d,) in classes.select("d").distinct().collect():  # one row a vector length
        size = min(SAMPLE_ROWS, max(k + 2, SAMPLE_BYTES // (8 * d)))
        taken = classes.filter(F.col("d") == d).orderBy("key").limit(size).select("v").toArrow()
        out[d] = _fit(_matrix(taken.column("v").combine_chunks()), lists, k)
    return out


def _filed(classes: DataFrame, indexes) -> DataFrame:
    """(d, list, low, v): each vector in the list of its nearest centre."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            d = batch.column(0).to_numpy()
            at = np.zeros(len(d), np.int32)
            for length in np.unique(d):
                index, rows = indexes.value[int(length)], np.flatnonzero(d == length)
                at[rows] = np.argmax(_unit(_matrix(batch.column(2).take(pa.array(rows)))) @ index.centres.T, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at), batch.column(1), batch.column(2)], ["d", "list", "low", "v"])

    return classes.select("d", "low", "v").mapInArrow(run, "d int, list int, low long, v array<double>")


def _visiting(classes: DataFrame, indexes, k: int) -> DataFrame:
    """(d, list, low, v, bound): a row for each list that a query visits, and a product that k rows of these lists reach."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            d = batch.column(0).to_numpy()
            for length in np.unique(d):
                index, rows = indexes.value[int(length)], np.flatnonzero(d == length)
                for lo in range(0, len(rows), QUERY_ROWS):
                    taken = pa.array(rows[lo : lo + QUERY_ROWS])
                    v, low = batch.column(2).take(taken), batch.column(1).take(taken).to_numpy()
                    q = _matrix(v)
                    near = np.argsort(-(q @ index.centres.T), axis=1)
                    # at least the visits fitted, and lists that hold k rows of the sample
                    filled = (np.cumsum(index.sizes[near], axis=1) < k).sum(axis=1) + 1
                    visited = np.arange(near.shape[1]) < np.maximum(filled, index.visits)[:, None]
                    seen = np.zeros_like(visited)
                    np.put_along_axis(seen, near, visited, axis=1)
                    products = np.where(seen[:, index.pivot_lists], q @ index.pivots.T, -np.inf)
                    have = products.shape[1]
                    bound = np.partition(products, have - k, axis=1)[:, have - k] if have >= k else np.full(len(q), -np.inf)
                    rep, at = np.nonzero(visited)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rep), length, np.int32)), pa.array(near[rep, at].astype(np.int32)), pa.array(low[rep]),
                         v.take(pa.array(rep)), pa.array(bound[rep])], ["d", "list", "low", "v", "bound"])

    return classes.filter("asked").select("d", "low", "v").mapInArrow(run, "d int, list int, low long, v array<double>, bound double")


def _cut(rows: DataFrame, size: int, indexes, extra: tuple[str, ...] = ()) -> DataFrame:
    """Neighbouring rows of one list as blocks (d, list, low, given, turned, extra..) of at most ``size`` rows.

    ``given`` holds the vectors by rows, ``turned`` the rotated ones by columns.
    """
    rows = rows.repartitionByRange("d", "list", "low").sortWithinPartitions("d", "list", "low").select("d", "list", "low", "v", *extra)
    names = ["d", "list", "low", "given", "turned", *extra]

    def block(part: pa.Table):
        v = _matrix(part["v"].combine_chunks())
        rotation = indexes.value[v.shape[1]].rotation
        values = [part["d"][0].as_py(), part["list"][0].as_py(), part["low"].to_numpy().tobytes(), v.tobytes(),
                  np.ascontiguousarray((v @ rotation).T).tobytes(), *[part[e].to_numpy().tobytes() for e in extra]]
        return pa.RecordBatch.from_arrays(
            [pa.array([x], pa.int32() if i < 2 else pa.binary()) for i, x in enumerate(values)], names)

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        count, current = 0, None
        for batch in batches:
            d, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(d) != 0) | (np.diff(lists) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(d)]):
                while a < b:
                    if held and (current != (d[a], lists[a]) or count == size):
                        yield block(pa.Table.from_batches(held))
                        held, count = [], 0
                    current = (d[a], lists[a])
                    n = min(b - a, size - count)
                    held.append(batch.slice(a, n))
                    a, count = a + n, count + n
        if held:
            yield block(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "d int, list int, low binary, given binary, turned binary" + "".join(f", {e} binary" for e in extra))


def _survivors(q: np.ndarray, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, product) of the pairs that no test abandons.

    ``q`` and ``x`` hold rotated vectors by columns.
    """
    d = len(x)
    size = np.sqrt((q * q).sum(axis=0))[:, None] * np.sqrt((x * x).sum(axis=0))[None, :]
    score = q[:WIDTH].T @ x[:WIDTH]
    i = j = flat = None
    for done in range(WIDTH, d + WIDTH, WIDTH):
        done = min(done, d)
        share = done / d
        spread = DEVIATIONS * np.sqrt(2 * share * (1 - share) / d) + SLACK
        if flat is None:
            i, j = np.nonzero(score >= share * bound[:, None] - spread * size)
            flat, size = score[i, j], size[i, j]
        else:
            alive = flat >= share * bound[i] - spread * size
            i, j, flat, size = i[alive], j[alive], flat[alive], size[alive]
        if done < d:
            rows = slice(done, min(done + WIDTH, d))
            if len(i) > q.shape[1] * x.shape[1] // 8:  # so many are left that a product of blocks is cheaper
                flat = flat + (q[rows].T @ x[rows])[i, j]
            else:
                flat = flat + np.einsum("ij,ij->j", q[rows][:, i], x[rows][:, j])
    return i, j, flat


def _best(query: np.ndarray, low: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's ``k`` highest scores, ties by ``low``."""
    order = np.lexsort((low, -score, query))
    first = np.searchsorted(query[order], query[order], "left")
    return order[np.arange(len(order)) - first < k]


def _compare(pairs: DataFrame, k: int) -> DataFrame:
    """(query, low, score): for each pair of blocks, each query's ``k`` best by exact product.

    Blocks of one list that follow each other share one result and hand a query's k-th
    product on.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        same, bound, best = None, None, None

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(x) for x in best], ["query", "low", "score"])

        for batch in batches:
            for qlow, qgiven, qturned, qbound, low, given, turned in zip(*(c.to_pylist() for c in batch.columns)):
                ql, xl = np.frombuffer(qlow, np.int64), np.frombuffer(low, np.int64)
                q, x = (np.frombuffer(b, float).reshape(-1, n) for b, n in ((qturned, len(ql)), (turned, len(xl))))
                if same != qlow:
                    if best is not None:
                        yield emit()
                    same, bound = qlow, np.frombuffer(qbound, float).copy()
                    best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                i, j, score = _survivors(q, x, bound)
                a, b = np.frombuffer(qgiven, float).reshape(len(ql), -1), np.frombuffer(given, float).reshape(len(xl), -1)
                # the k-th rotated product of this block bounds what is worth an exact one
                held = _best(i, xl[j], score, k)
                worst = np.full(len(ql), np.inf)
                np.minimum.at(worst, i[held], score[held])
                bound = np.where(np.bincount(i[held], minlength=len(ql)) == k, np.maximum(bound, worst), bound)
                near = score >= bound[i] - SLACK * np.sqrt((q * q).sum(axis=0))[i] * np.sqrt((x * x).sum(axis=0))[j]
                i, j = i[near], j[near]
                exact = np.concatenate([np.zeros(0), *[(a[i[s : s + 4096]] * b[j[s : s + 4096]]).sum(axis=1) for s in range(0, len(i), 4096)]])
                merged = [np.concatenate(pair) for pair in zip(best, (ql[i], xl[j], exact))]
                held = _best(*merged, k)
                best = tuple(m[held] for m in merged)
        if best is not None:
            yield emit()

    return pairs.mapInArrow(run, "query long, low long, score double")


def nearest(
    df: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", is_query=lambda i: i % 20 == 0, lists: int = 64,
) -> DataFrame:
    """``(query_id, rank, id_col, score)``: for each row that ``is_query`` takes, its ``k`` nearest found of all other rows.

    Nearness is the inner product in double precision, ``score`` that of the vectors as given;
    ties go to the smaller id. Vectors that are null, zero or hold a null, NaN or infinite
    component take no part, nor do rows without an id. Rows of one id are one row (of several
    vectors the one of smallest hash). Vectors of different lengths are never compared. Other
    columns are ignored. A query without candidates has no rows; an empty table gives none.
    ``lists`` is the number of lists of each vector length: the more of them, the smaller the
    part of a table with clear clusters that a query visits.
    """
    spark = df.sparkSession
    arrow_limits(spark)
    rows, classes = _classes(df, id_col, vec_col, is_query)
    indexes = spark.sparkContext.broadcast(_indexes(classes, lists, k))
    wanted = k + 1  # a query's own entry may be among them
    index = settle(_cut(_filed(classes, indexes), BLOCK_ROWS, indexes), "index")
    asked = settle(_cut(_visiting(classes, indexes, wanted), QUERY_ROWS, indexes, ("bound",)), "asked")
    queries = asked.select("d", "list", F.col("low").alias("qlow"), F.col("given").alias("qgiven"), F.col("turned").alias("qturned"), "bound")
    pairs = queries.join(index, ["d", "list"]).select("qlow", "qgiven", "qturned", "bound", "low", "given", "turned")
    found = _compare(pairs, wanted)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "low")
    found = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= wanted).drop("r")
    # entries to members: no query needs more than the first k + 1 of an entry
    keys = classes.select("key", "low")
    in_order = Window.partitionBy("key").orderBy("id")
    members = rows.withColumn("r", F.row_number().over(in_order)).filter(F.col("r") <= wanted).drop("r").join(keys, "key").select("low", "id")
    answers = found.join(members, "low").withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id")))
    answers = answers.filter(F.col("r") <= wanted).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("found"))
    asking = rows.filter(is_query(F.col("id"))).join(keys.withColumnRenamed("low", "query"), "key").select("query", F.col("id").alias("query_id"))
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    listed = asking.join(answers, "query").select("query_id", F.posexplode(others).alias("at", "x"))
    return listed.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))
