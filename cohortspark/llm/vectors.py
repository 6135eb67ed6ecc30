"""Embedding near-duplicates by PCA-ordered tiles.

Unit vectors are rotated into the principal axes of their table, largest variance first.
Vectors of a group are sorted along the first axis and cut into tiles. Two unit vectors of
cosine c differ by ``2 - 2c`` in squared distance, so a pair of tiles whose bounding boxes
over the leading axes lie further apart is never compared; the others meet on the cells of
the first axis. Inside a pair of tiles the leading dimensions are accumulated first, the
rest is bounded by the product of the suffix norms (Cauchy-Schwarz), and only pairs that can
still reach the threshold get the remaining dimensions. Equal vectors are one row with a
count, and a pair of tiles returns counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.components import components
from cohortspark.llm.textops import arrow_limits
from cohortspark.sources.stored import settle

TILE = 512
LEAD = 8  # leading axes of the bounding boxes and of the first accumulation
MARGIN = 1e-9  # rotation noise; closer pairs are decided on the vectors as given


def _keyed(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, v, key) of all rows; the key is null for a vector that cannot link."""
    v = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    key = F.sha2(F.to_binary(F.concat_ws(",", F.col("v").cast("array<string>")), F.lit("utf-8")), 256)
    return rows.withColumn("key", F.when(usable, key))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of one length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _axes(rows: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes for each vector length, from partial sums of products."""

    def run(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            lengths = batch.column(1).to_numpy()
            for d in np.unique(lengths):
                m = _unit(_matrix(batch.column(0).filter(pa.array(lengths == d))))
                s = sums.setdefault(int(d), [0, np.zeros(d), np.zeros((d, d))])
                s[0], s[1], s[2] = s[0] + len(m), s[1] + m.sum(axis=0), s[2] + m.T @ m
        for d, (n, one, two) in sums.items():
            yield pa.RecordBatch.from_pylist([{"d": d, "n": n, "one": one.tolist(), "two": two.reshape(-1).tolist()}],
                                             pa.schema([("d", pa.int64()), ("n", pa.int64()), ("one", pa.list_(pa.float64())), ("two", pa.list_(pa.float64()))]))

    parts = rows.select("v", F.size("v").cast("long").alias("d")).mapInArrow(run, "d long, n long, one array<double>, two array<double>")
    cells = parts.select("d", "n", F.posexplode(F.concat("one", "two")).alias("i", "x"))
    sums = cells.groupBy("d", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toPandas()  # d + d*d numbers a length
    axes = {}
    for d, part in sums.groupby("d"):
        part = part.sort_values("i")
        n, x = float(part.n.iloc[0]), part.x.to_numpy()
        mean = x[:d] / n
        _, vectors = np.linalg.eigh(x[d:].reshape(d, d) / n - np.outer(mean, mean))
        axes[int(d)] = vectors[:, ::-1].copy()
    return axes


def _tiles(rows: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """Tiles (group, tile, lo, hi, ids, copies, vectors) of rows (id, copies, label, v)."""

    def project(batches):
        for batch in batches:
            lengths = batch.column(4).to_numpy()
            first = np.zeros(len(lengths))
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                first[at] = _unit(_matrix(batch.column(3).take(pa.array(at)))) @ axes[int(d)][:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first)], [*batch.schema.names, "x"])

    kind = rows.schema["label"].dataType.simpleString()
    placed = rows.select("id", "copies", "label", "v", F.size("v").cast("long").alias("d")).mapInArrow(
        project, f"id long, copies long, label {kind}, v array<double>, d long, x double")
    ordered = placed.withColumn("grp", F.xxhash64("label", "d")).repartitionByRange("grp", "x", "id").sortWithinPartitions("grp", "x", "id")

    def cut(batches):
        held: list[pa.RecordBatch] = []

        def emit(rows):
            v = _matrix(rows.column("v").combine_chunks())
            p = _unit(v) @ axes[v.shape[1]]
            lead = p[:, :LEAD]
            ids = rows["id"].to_numpy()
            return {"grp": rows["grp"][0].as_py(), "tile": int(ids.min()), "lo": lead.min(axis=0).tolist(), "hi": lead.max(axis=0).tolist(),
                    "ids": ids.tobytes(), "copies": rows["copies"].to_numpy().tobytes(), "vectors": v.tobytes(), "n": len(ids)}

        schema = pa.schema([("grp", pa.int64()), ("tile", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())),
                            ("ids", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary()), ("n", pa.int64())])
        for batch in batches:
            grp = batch.column(2).to_numpy()
            at = 0
            while at < len(grp):
                have = sum(b.num_rows for b in held)
                if held and (held[0].column(2)[0].as_py() != grp[at] or have == TILE):
                    yield pa.RecordBatch.from_pylist([emit(pa.Table.from_batches(held))], schema)
                    held, have = [], 0
                end = min(at + TILE - have, at + int(np.searchsorted(grp[at:], grp[at], "right")))
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield pa.RecordBatch.from_pylist([emit(pa.Table.from_batches(held))], schema)

    return ordered.select("id", "copies", "grp", "v").mapInArrow(
        cut, "grp long, tile long, lo array<double>, hi array<double>, ids binary, copies binary, vectors binary, n long")


def _tile_pairs(tiles: DataFrame, reach: float) -> DataFrame:
    """Pairs (t, s), t <= s, of one group whose boxes are no further apart than ``reach``."""
    cell = lambda x: F.floor(x / reach).cast("long")
    boxes = tiles.select("grp", "tile", "lo", "hi")
    mine = boxes.select("grp", F.col("tile").alias("t"), F.col("lo").alias("tlo"), F.col("hi").alias("thi"),
                        F.explode(F.sequence(cell(F.col("lo")[0]), cell(F.col("hi")[0]))).alias("cell"))
    near = boxes.select("grp", F.col("tile").alias("s"), F.col("lo").alias("slo"), F.col("hi").alias("shi"),
                        F.explode(F.sequence(cell(F.col("lo")[0]) - 1, cell(F.col("hi")[0]) + 1)).alias("cell"))
    gaps = F.zip_with(F.arrays_zip("tlo", "thi"), F.arrays_zip("slo", "shi"),
                      lambda a, b: F.greatest(a["tlo"] - b["shi"], b["slo"] - a["thi"], F.lit(0.0)))
    distance = F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g)
    return (mine.join(near, ["grp", "cell"]).filter(F.col("t") <= F.col("s")).filter(distance <= reach * reach + MARGIN)
            .select("grp", "t", "s").distinct())


def _linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs of rows that reach the threshold."""
    ua, ub = _unit(a), _unit(b)
    pa_, pb = ua @ axes, ub @ axes
    d = pa_.shape[1]
    out = np.ones((len(a), len(b)), bool)
    score = np.zeros((len(a), len(b)))
    done = 0
    for width in (LEAD, 3 * LEAD, d):  # accumulate; stop where the rest cannot lift a pair to the threshold
        width = min(width, d)
        if width > done:
            score += pa_[:, done:width] @ pb[:, done:width].T
            done = width
        if done < d:
            rest = np.sqrt((pa_[:, done:] ** 2).sum(1))[:, None] * np.sqrt((pb[:, done:] ** 2).sum(1))[None, :]
            if not (score + rest >= threshold - MARGIN).any():
                return np.zeros_like(out)
    out = score >= threshold
    for i, j in zip(*np.nonzero(np.abs(score - threshold) <= MARGIN)):
        out[i, j] = float(a[i] @ b[j]) / math.sqrt(float(a[i] @ a[i]) * float(b[j] @ b[j])) >= threshold
    return out


def _forest(linked: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links between two tiles."""
    ids = ids_a if same else np.concatenate([ids_a, ids_b])
    shift = 0 if same else len(ids_a)
    todo, out = np.ones(len(ids), bool), []
    for root in range(len(ids)):
        if not todo[root]:
            continue
        todo[root] = False
        front = [root]
        while front:
            i = front.pop()
            if same:
                next_ = np.flatnonzero(linked[i] & todo)
            elif i < shift:
                next_ = shift + np.flatnonzero(linked[i] & todo[shift:])
            else:
                next_ = np.flatnonzero(linked[:, i - shift] & todo[:shift])
            todo[next_] = False
            out.extend((int(ids[i]), int(ids[j])) for j in next_)
            front.extend(next_.tolist())
    return out


def similar_vectors(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98,
) -> DataFrame:
    """``(id_col, n_links, component_id, kept)``, one row per vector.

    Vectors of equal, non-null labels and equal length link when their cosine in double
    precision is at least ``threshold``. Null and zero vectors, and those that hold a null,
    NaN or infinite component, link with nothing. ``n_links`` counts other vectors, equal
    ones included; ``component_id`` is the smallest id reachable. Ids are unique; repeated rows
    count as vectors of their own. Rows without an id link with nothing else than equal
    vectors. An empty table gives an empty result.
    """
    spark = df.sparkSession
    arrow_limits(spark)
    rows = _keyed(df, id_col, vec_col, label_col)
    usable = rows.filter("key is not null")
    same = usable.filter("id is not null").groupBy("label", "key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    same = settle(same, "vectors")
    axes = _axes(same)
    tiles = settle(_tiles(same.select("id", "copies", "label", "v"), axes), "tiles")
    pairs = _tile_pairs(tiles, math.sqrt(max(2 - 2 * threshold, 1e-12)))
    packed = tiles.select("tile", "ids", "copies", "vectors")
    both = (pairs.join(packed.toDF("t", "ti", "tc", "tv"), "t").join(packed.toDF("s", "si", "sc", "sv"), "s")
            .select("t", "s", "ti", "tc", "tv", "si", "sc", "sv"))

    def compare(batches):
        for batch in batches:
            for row in zip(*[c for c in batch.columns]):
                t, s, ti, tc, tv, si, sc, sv = (x.as_py() for x in row)
                ids_a, ids_b = np.frombuffer(ti, np.int64), np.frombuffer(si, np.int64)
                a, b = (np.frombuffer(x, float).reshape(n, -1) for x, n in ((tv, len(ids_a)), (sv, len(ids_b))))
                linked = _linked(a, b, axes[a.shape[1]], threshold)
                if t == s:
                    np.fill_diagonal(linked, False)
                out = [(i, None, int(n)) for i, n in zip(ids_a.tolist(), linked @ np.frombuffer(sc, np.int64)) if n]
                if t != s:
                    out += [(i, None, int(n)) for i, n in zip(ids_b.tolist(), np.frombuffer(tc, np.int64) @ linked) if n]
                out += [(i, j, 0) for i, j in _forest(linked, ids_a, ids_b, t == s)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], ["a", "b", "n"])

    found = settle(both.mapInArrow(compare, "a long, b long, n long"), "links")
    counts = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    parts = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("id", "rep")
    reps = (same.select("label", "key", F.col("id").alias("rep"), "copies").join(counts, "rep", "left").join(parts, "rep", "left")
            .select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = rows.select("id", "label", "key").join(reps, ["label", "key"], "left").select("id", "n_links", "component_id")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
