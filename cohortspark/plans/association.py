"""Linear and Cox association scans over genotype dosages, long or in tiles.

People are few next to dosages. Everything that depends on people alone (orthonormal
covariates, residual phenotype) is a column of the people table; a scan is one join of the
dosages with it and one sum per variant, with partial sums before the shuffle. A variant
needs no row for a person whose dosage is unknown: the missing ones take the variant's mean,
added in closed form afterwards.

A matrix that is scanned more than once is stored in tiles: some variants by a block of
samples a row. The people become one row a block, with the columns of every phenotype side by
side; tiles meet them on the block and a task multiplies the two, so one pass over the dosages
serves all phenotypes, and neither side is gathered anywhere. Phenotypes known of the same people
with the same covariates share the counts and the covariates' columns and sums, which are most of
what is shuffled.
"""

from __future__ import annotations

import copy
import math
import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.linear import combine, gram
from cohortspark.functions.numeric import log10_normal_two_sided, t_log10_pvalue
from cohortspark.operators.ordered import BOUNDED, quantile_slices, running
from cohortspark.session import arrow_bytes
from cohortspark.sources.stored import last_written, lifetime, settle, settle_parts

BLOCK = 4096  # samples of a tile
MARKERS = 128  # variants of a full tile, about: they are dealt by hash
SPARSE = 16  # a tile of which less than one part in so many is known holds its known dosages alone
PIECE = 1 << 16  # known dosages of a sparse tile multiplied at a time
SUMS = 4  # bytes of sums that products of stored tiles hand on at a time, by byte of the tiles
TARGETS = 16  # phenotypes that share a basis, at most: their sums are columns of one row


class People:
    """The people side of a scan: rows, an orthonormal covariate basis and its totals.

    Several targets of the same people share all but their own columns and totals; those read
    are the first target's, ``of`` gives another's.
    """

    def __init__(self, table: DataFrame, keys: Sequence[str], target: str | Sequence[str], covariates: Sequence[str]):
        targets = [target] if isinstance(target, str) else list(target)
        rows = table.select(*keys, *targets, *covariates).dropna("any", subset=[*targets, *covariates])
        rows = settle(rows, "people")  # read for the sums below and by each scan
        means = rows.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(covariates)], F.count(F.lit(1))).first()
        # centred, so that covariates far from zero do not look like the intercept
        design = [F.lit(1.0), *[F.col(c).cast("double") - F.lit(float(u or 0.0)) for c, u in zip(covariates, means)]]
        values = [F.col(t).cast("double") for t in targets]
        m = gram(rows, [*design, *values])
        k = len(design)
        basis = _basis(m[:k, :k])  # columns of weights on the design
        if basis.shape[1] < k and m[0, 0]:
            warnings.warn(f"{k - basis.shape[1]} of {len(covariates)} covariates of {', '.join(targets)} depend on the others", stacklevel=3)
        self.n = int(round(m[0, 0]))
        self.rank = basis.shape[1]
        self.q_total = basis.T @ m[:k, 0]  # sums of each basis column
        self.at = 0
        self.q_targets = basis.T @ m[:k, k:]
        self.y_totals, self.yys = m[0, k:], np.diag(m)[k:]
        self.ys = ["y", *[f"y{i}" for i in range(1, len(targets))]]
        self.columns = [f"q{j}" for j in range(self.rank)]
        self.rows = rows.select(
            *keys, *[v.alias(y) for v, y in zip(values, self.ys)], *[combine(design, w).alias(c) for c, w in zip(self.columns, basis.T)])

    y = property(lambda self: self.ys[self.at])
    y_total = property(lambda self: float(self.y_totals[self.at]))
    yy = property(lambda self: float(self.yys[self.at]))
    q_target = property(lambda self: self.q_targets[:, self.at])

    def of(self, at: int) -> "People":
        """The same people, read for another target."""
        other = copy.copy(self)
        other.at = at
        return other

    def residual(self) -> "People":
        """Replace the targets by what the covariates leave of them."""
        basis = [F.col(c) for c in self.columns]
        self.rows = self.rows.withColumns({y: F.col(y) - combine(basis, q) for y, q in zip(self.ys, self.q_targets.T)})
        self.yys = self.yys - np.sum(self.q_targets ** 2, axis=0)
        self.y_totals = self.y_totals - self.q_total @ self.q_targets
        self.q_targets = np.zeros_like(self.q_targets)
        return self


def _basis(m: np.ndarray) -> np.ndarray:
    scale = 1.0 / np.sqrt(np.where(np.diag(m) > 0, np.diag(m), 1.0))
    values, vectors = np.linalg.eigh(m * np.outer(scale, scale))
    keep = values > 1e-10 * max(values.max(), 1e-300)
    return (vectors[:, keep] * scale[:, None]) / np.sqrt(values[keep])


def _long_sums(dosages: DataFrame, people: People) -> DataFrame:
    """Sums over the known dosages of each marker, from (marker_id, id, dosage) rows.

    The rows of an id share its dosages, so they are added up before they meet them.
    """
    g, y, k = F.col("dosage"), F.col("y"), F.col("_k")
    each = people.rows.groupBy("id").agg(F.count(F.lit(1)).alias("_k"), *[F.sum(c).alias(c) for c in ("y", *people.columns)])
    joined = dosages.filter(g.isNotNull()).select("marker_id", "id", "dosage").join(each, "id")
    sums = [F.sum(k).alias("n"), F.sum(g * k).alias("sg"), F.sum(g * g * k).alias("sgg"), F.sum(g * y).alias("sgy"), F.sum(y).alias("sy")]
    for c in people.columns:
        sums += [F.sum(g * F.col(c)).alias(f"sg_{c}"), F.sum(c).alias(f"s_{c}")]
    return joined.groupBy("marker_id").agg(*sums)


def _width(people: People) -> int:
    return 1 + len(people.ys) + people.rank


def _people_blocks(people: Sequence[People], samples: DataFrame) -> DataFrame:
    """(block, people): per block of samples the columns 1, targets and basis of each of ``people``, side by side."""
    width, parts, lo = sum(_width(p) for p in people), None, 0
    for p in people:
        values = F.array(F.lit(1.0), *p.ys, *p.columns)
        rows = p.rows.join(samples.select("id", (F.col("i") - 1).alias("_at")), "id").select(
            F.floor(F.col("_at") / BLOCK).cast("int").alias("block"), (F.col("_at") % BLOCK).cast("int").alias("at"), F.lit(lo).alias("lo"), values.alias("x"))
        parts = rows if parts is None else parts.unionByName(rows)
        lo += _width(p)
    size = BLOCK

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((size, width))
        for lo, part in pdf.groupby("lo"):
            x = np.stack(part["x"].to_numpy())
            m[part["at"].to_numpy(), lo : lo + x.shape[1]] = x
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "people": [m.tobytes()]})

    return parts.groupBy("block").applyInPandas(build, "block int, people binary")


def _tile_sums(tiles: DataFrame, samples: DataFrame, people: Sequence[People]) -> DataFrame:
    """(marker_id, number t in ``people``, sums as in ``_long_sums``, of each target), from one pass over the tiles."""
    return _products(tiles, settle(_people_blocks(people, samples), "people-blocks"), people)


def _sum_names(people: Sequence[People]) -> list[str]:
    ys, rank = max((p.ys for p in people), key=len), max(p.rank for p in people)
    return ["n", "sg", "sgg", *[f"{s}{y}" for y in ys for s in ("sg", "s")], *[f"{s}_q{j}" for j in range(rank) for s in ("sg", "s")]]


def _rounds(tiles: DataFrame, people: Sequence[People]) -> int:
    """In how many parts the variants are multiplied, so that the sums of one are a few times the tiles.

    Tiles with one dosage of each variant hand on many times their bytes: a row of sums a variant and block.
    """
    rows, size = tiles.agg(F.sum(F.size("markers")), F.sum(
        F.length("dosages") + F.coalesce(F.length("cells"), F.lit(0)) + 8 * F.size("markers"))).first()
    return max(1, math.ceil((rows or 0) * len(people) * len(_sum_names(people)) * 8 / (SUMS * (size or 1))))


def _products(tiles: DataFrame, blocks: DataFrame, people: Sequence[People], part: int = 0, parts: int = 1) -> DataFrame:
    """The sums of tiles and ``_people_blocks``, for one of several parts of the variants, dealt by hash."""
    spark = tiles.sparkSession
    arrow_bytes(spark)
    # a block meets many tiles: its copies are spread over as many keys as there are partitions
    copies = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // max(blocks.count(), 1))
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    joined = tiles.withColumn("part", (F.col("chunk") % copies).cast("int")).join(blocks, ["block", "part"])
    # a null says that all variants are multiplied
    wanted = F.transform("markers", lambda m: F.pmod(F.xxhash64(m), F.lit(parts)) == part) if parts > 1 else F.lit(None).cast("array<boolean>")
    joined = joined.select("markers", "dosages", "cells", "people", wanted.alias("wanted"))
    size, piece = BLOCK, PIECE
    own, ranks = [len(p.ys) for p in people], [p.rank for p in people]
    names = _sum_names(people)
    inner = tiles.schema["markers"].dataType.elementType.simpleString()
    one = [sum(map(_width, people[:t])) for t in range(len(people))]  # the first column of its people, that of 1

    def full(g, x):
        known = ~np.isnan(g)
        g[~known] = 0.0
        return g @ x, known.astype(float) @ x, (g * g) @ x[:, one]

    def sparse(values, place, x):
        """The same sums by variant, some whole variants at a time; their places are sorted."""
        variant, start = place // size, 0
        while start < len(place):
            end = min(start + piece, len(place))
            if end < len(place):
                end = int(np.searchsorted(variant, variant[end], "left"))
                end = end if end > start else int(np.searchsorted(variant, variant[start], "right"))
            v, first = np.unique(variant[start:end], return_index=True)
            rows, g = x[place[start:end] % size], values[start:end, None].astype(float)
            yield v, np.add.reduceat(rows * g, first), np.add.reduceat(rows, first), np.add.reduceat(rows[:, one] * g * g, first)
            start = end

    def products(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for markers, dosages, cells, matrix, wanted in zip(*batch.columns):
                x, g = np.frombuffer(matrix.as_py(), float).reshape(size, -1), np.frombuffer(dosages.as_py(), np.float32)
                mine = wanted.values.to_numpy(zero_copy_only=False) if wanted.is_valid else np.ones(len(markers), bool)
                if cells.is_valid:
                    place = np.frombuffer(cells.as_py(), np.int64)
                    keep = mine[place // size]
                    found = sparse(g[keep], place[keep], x)
                else:
                    found = [(np.flatnonzero(mine), *full(g.reshape(-1, size)[mine].astype(float), x))]
                for v, gx, kx, ggx in found:
                    for t, (lo, ys, rank) in enumerate(zip(one, own, ranks)):
                        met = np.flatnonzero(kx[:, lo])  # variants known of some of these people
                        cols = [kx[met, lo], gx[met, lo], ggx[met, t]]
                        for first, has, most in ((lo + 1, ys, max(own)), (lo + 1 + ys, rank, max(ranks))):
                            for j in range(most):
                                cols += [gx[met, first + j], kx[met, first + j]] if j < has else [np.zeros(len(met))] * 2
                        ids = markers.values.take(pa.array(v[met]))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(met), t, np.int32)), *map(pa.array, cols)], ["marker_id", "t", *names])

    each = joined.mapInArrow(products, f"marker_id {inner}, t int, " + ", ".join(f"{c} double" for c in names))
    sums = each.groupBy("marker_id", "t").agg(*[F.sum(c).alias(c) for c in names])
    return sums.withColumn("n", F.col("n").cast("long")).filter("n > 0")


def _complete(per_marker: DataFrame, people: People) -> DataFrame:
    """Per marker over all people (missing dosages at the mean): n, freq, gg, gy, g0.. (g times basis)."""
    mean, missing = F.col("sg") / F.col("n"), F.lit(people.n) - F.col("n")
    filled = per_marker.select(
        "marker_id", "n", (mean / 2).alias("freq"), mean.alias("_mean"),
        (F.col("sgg") + missing * mean * mean).alias("gg"),
        (F.col(f"sg{people.y}") + mean * (F.lit(people.y_total) - F.col(f"s{people.y}"))).alias("gy"),
        *[(F.col(f"sg_{c}") + mean * (F.lit(float(t)) - F.col(f"s_{c}"))).alias(f"g{i}")
          for i, (c, t) in enumerate(zip(people.columns, people.q_total))])
    explained = sum((F.col(f"g{i}") * F.col(f"g{i}") for i in range(people.rank)), F.lit(0.0))
    return filled.withColumn("rest", F.col("gg") - explained).filter(F.col("rest") > 1e-8 * F.greatest(F.col("gg"), F.lit(1.0)))


def linear(dosages: DataFrame, phenotype: DataFrame, covariates: DataFrame, names: Sequence[str], cohort: DataFrame | None = None,
           target: str = "score") -> DataFrame:
    """Regress the target on each variant's dosage and the covariates.

    phenotype: id, target; covariates: id and the named columns. People with a missing value
    are left out. Output: marker_id, n, freq, estim, std_err, score. Variants without
    variation beyond the covariates have no row.
    """
    people = _scan_people(phenotype, covariates, names, cohort, target)
    return _estimates(_complete(_long_sums(dosages, people), people), people)


def linear_packed(tiles: DataFrame, samples: DataFrame, phenotype: DataFrame, covariates: DataFrame, names: Sequence[str],
                  cohort: DataFrame | None = None, target: str = "score") -> DataFrame:
    """The same scan over tiles; samples: id, i (position from 1)."""
    people = _scan_people(phenotype, covariates, names, cohort, target)
    return _estimates(_complete(_tile_sums(tiles, samples, [people]), people), people)


def linear_traits(tiles: DataFrame, samples: DataFrame, phenotypes: DataFrame, covariates: DataFrame, names: Sequence[str],
                  traits: Sequence[str], cohort: DataFrame | None = None, trait_col: str = "trait", target: str = "score") -> DataFrame:
    """One scan of stored tiles for several phenotypes, each with its own people.

    Each dosage is multiplied once for all of them; where few are known, in parts of the variants
    (see ``_rounds``), each of which reads the tiles.
    phenotypes: id, trait, target; covariates: id, names and, where they differ by trait, the
    trait. Output as of ``linear`` with the trait in front.
    """
    table = _trait_rows(phenotypes, covariates, names, cohort, trait_col, target).filter(F.col(trait_col).isin(list(traits)))
    with lifetime(tiles.sparkSession) as keep:  # the sums hold all that is read in the end
        people, found = _shared_people(table, names, list(dict.fromkeys(traits)), trait_col, target)
        blocks, parts = settle(_people_blocks(people, samples), "people-blocks"), _rounds(tiles, people)
        # a row a variant and its people, read once for each trait; the shuffle files of one part go before the next
        sums = settle_parts((_products(tiles, blocks, people, part, parts) for part in range(parts)), "sums")
        keep.append(last_written(tiles.sparkSession))
    out = None
    for t in traits:
        i, at = found[t]
        p = people[i].of(at)
        part = _estimates(_complete(sums.filter(F.col("t") == i), p), p).withColumn(trait_col, F.lit(t))
        out = part if out is None else out.unionByName(part)
    return out.select(trait_col, *[c for c in out.columns if c != trait_col])


def _trait_rows(phenotypes, covariates, names, cohort, trait_col, target) -> DataFrame:
    """(trait, id, target, names): the people of each trait, without missing values."""
    if cohort is not None:
        phenotypes = phenotypes.join(cohort.select("id"), "id", "left_semi")
    on = ["id", trait_col] if trait_col in covariates.columns else ["id"]
    rows = phenotypes.select("id", trait_col, target).join(covariates.select(*on, *names), on)
    return rows.select(trait_col, "id", target, *names).dropna("any", subset=[target, *names])


def _shared_people(table: DataFrame, names: Sequence[str], traits: Sequence[str], trait_col: str,
                   target: str) -> tuple[list[People], dict[str, tuple[int, int]]]:
    """The people of all traits, and where each trait stands: which of them, which of their targets.

    Traits share a basis where they are known of the same people, as often and with the same
    covariates. That is found from one row per person and covariates: the sum of its 64-bit hashes
    over a trait's people. A trait with several values in such a row keeps its own rows.
    """
    of = [F.col(trait_col) == t for t in traits]
    wide = settle(table.groupBy("id", *names).agg(*[
        c for i, mine in enumerate(of) for c in (F.count_if(mine).alias(f"n{i}"), F.min(F.when(mine, F.col(target))).alias(f"lo{i}"),
                                                 F.max(F.when(mine, F.col(target))).alias(f"hi{i}"))]), "traits")
    marks = wide.agg(*[
        c for i in range(len(traits)) for c in (F.sum(F.when(F.col(f"n{i}") > 0, F.xxhash64("id", *names, f"n{i}").cast("decimal(38,0)"))),
                                                F.coalesce(F.bool_or(F.col(f"lo{i}") != F.col(f"hi{i}")), F.lit(False)))]).first()
    groups: dict[tuple, list[list[int]]] = {}
    for i in range(len(traits)):
        mark, several = marks[2 * i : 2 * i + 2]
        alike = groups.setdefault((mark, i if several else None), [[]])
        if len(alike[-1]) == TARGETS:
            alike.append([])
        alike[-1].append(i)
    people, found = [], {}
    for (_, several), alike in groups.items():
        for members in alike:
            if several is None:
                rows = wide.filter(F.col(f"n{members[0]}") > 0).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col(f"n{members[0]}").cast("int"))))
                targets = [f"_{target}{i}" for i in members]
                rows = rows.select("id", *names, *[F.col(f"hi{i}").alias(t) for i, t in zip(members, targets)])
            else:
                rows, targets = table.filter(of[several]), [target]
            for at, i in enumerate(members):
                found[traits[i]] = len(people), at
            people.append(People(rows, ["id"], targets, names).residual())
    return people, found


def pack_dosages(dosages: DataFrame, samples: DataFrame) -> DataFrame:
    """Tiles (block, chunk, markers ARRAY, dosages BINARY, cells BINARY) of known dosages.

    The layout to store a large matrix in: four bytes a dosage, a row for about MARKERS
    variants by BLOCK samples, unknown ones as NaN. Where few are known, more variants share a
    tile, so that it holds as many known dosages; those alone are stored then, with their places
    (variant * BLOCK + sample) in ``cells``, which is null for a full tile. Variants are dealt
    to chunks by hash, and a task builds one tile after another from its sorted rows. samples:
    id, i (from 1).
    """
    arrow_bytes(dosages.sparkSession)
    known = dosages.filter(F.col("dosage").isNotNull()).select("marker_id", "id", F.col("dosage").cast("float").alias("dosage"))
    known = settle(known, "known")  # counted, then packed
    kind, size, most = dosages.schema["marker_id"].dataType.simpleString(), BLOCK, BLOCK * MARKERS
    n, held = known.agg(F.approx_count_distinct("marker_id"), F.count(F.lit(1))).first()
    people = samples.agg(F.max("i")).first()[0] or 0
    chunks = min(-(-n // MARKERS), -(-held // (max(-(-people // size), 1) * most)))
    chunk = F.pmod(F.xxhash64("marker_id"), F.lit(max(1, chunks))).cast("int")
    at = F.col("i") - 1
    cells = known.join(samples.select("id", "i"), "id").select(
        F.floor(at / BLOCK).cast("int").alias("block"), chunk.alias("chunk"), "marker_id", (at % BLOCK).cast("int").alias("at"), "dosage")
    cells = cells.repartition("block", "chunk").sortWithinPartitions("block", "chunk", "marker_id")

    def tile(rows: pa.Table) -> pa.RecordBatch:
        coded = rows["marker_id"].combine_chunks().dictionary_encode("encode")
        place = coded.indices.to_numpy().astype(np.int64) * size + rows["at"].to_numpy()
        values, full = rows["dosage"].to_numpy(), len(coded.dictionary) * size
        if len(place) * SPARSE >= full:
            g, where = np.full(full, np.nan, np.float32), None
            g[place] = values
        else:
            place, last = np.unique(place[::-1], return_index=True)  # a place holds one dosage, the last one
            g, where = values[::-1][last], place.tobytes()
        markers = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        return pa.RecordBatch.from_arrays([
            rows["block"].combine_chunks()[:1], rows["chunk"].combine_chunks()[:1], markers, pa.array([g.tobytes()], pa.binary()), pa.array([where], pa.binary())],
            ["block", "chunk", "markers", "dosages", "cells"])

    def build(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            block, chunk = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(block) | np.diff(chunk)) + 1), len(block)]
            for a, b in zip(edges[:-1], edges[1:]):
                if held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != (block[a], chunk[a]):
                    yield tile(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                if sum(map(len, held)) >= 2 * most:  # a fuller part of a sparse matrix: the last variant waits for its rest
                    rows = pa.Table.from_batches(held)
                    ids = rows["marker_id"].combine_chunks().dictionary_encode("encode").indices.to_numpy()
                    cut = int(np.searchsorted(ids, ids[-1]))
                    if cut:
                        yield tile(rows.slice(0, cut))
                        held = rows.slice(cut).to_batches()
        if held:
            yield tile(pa.Table.from_batches(held))

    return cells.mapInArrow(build, f"block int, chunk int, markers array<{kind}>, dosages binary, cells binary")


def _scan_people(phenotype, covariates, names, cohort, target) -> People:
    if cohort is not None:
        phenotype = phenotype.join(cohort.select("id"), "id", "left_semi")
    table = phenotype.select("id", target).join(covariates.select("id", *names), "id")
    return People(table, ["id"], target, names).residual()


def _estimates(per_marker: DataFrame, people: People) -> DataFrame:
    df = people.n - people.rank - 1
    estim = F.col("gy") / F.col("rest")
    rss = F.greatest(F.lit(people.yy) - estim * F.col("gy"), F.lit(0.0))
    rows = per_marker.withColumns({"estim": estim, "std_err": F.sqrt(rss / F.lit(float(df)) / F.col("rest"))})
    return rows.select(
        "marker_id", "n", "freq", "estim", "std_err",
        (F.col("estim") / F.when(F.col("std_err") > 0, F.col("std_err"))).alias("score"), F.lit(float(df)).alias("df"))


def with_t_pvalue(results: DataFrame) -> DataFrame:
    """Add pval, the log10 two-sided p-value of the score on its degrees of freedom."""
    return results.withColumn("pval", t_log10_pvalue(F.col("score"), F.col("df")))


# --- Cox ------------------------------------------------------------------------------

EFRON_CHUNK = 1000


def _tie_sums(grid: DataFrame) -> DataFrame:
    """Sums over the ties of each event time, a long run of ties in chunks.

    For l = 0..d-1 with w = l/d and u = 1/(S0 - w*D0): a0 = sum u, a1 = sum w*u,
    b0 = sum u^2, b1 = sum w*u^2, b2 = sum w^2*u^2 (Efron's treatment of ties).
    """
    d = F.col("d").cast("long")
    chunks = grid.filter(d > 0).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((d - 1) / EFRON_CHUNK))))
    lo = F.col("_chunk") * EFRON_CHUNK
    hi = F.least(lo + EFRON_CHUNK - 1, d - 1)
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("a0", "a1", "b0", "b1", "b2")])

    def step(acc, l):
        w = l / F.col("d")
        u = F.lit(1.0) / (F.col("s0") - w * F.col("e0"))
        return F.struct(
            (acc["a0"] + u).alias("a0"), (acc["a1"] + w * u).alias("a1"), (acc["b0"] + u * u).alias("b0"),
            (acc["b1"] + w * u * u).alias("b1"), (acc["b2"] + w * w * u * u).alias("b2"))

    return chunks.withColumn("_t", F.aggregate(F.sequence(lo, hi), zero, step)).select(
        "*", *[F.col(f"_t.{n}") for n in ("a0", "a1", "b0", "b1", "b2")]).drop("_t")


def _risk_sums(rows: DataFrame, beta: Sequence[float], names: Sequence[str], moments: bool, slices: int) -> DataFrame:
    """Per time: d events, sums of exp(x*beta) over those at risk (s*) and dying (e*)."""
    x = [F.col(c) for c in names]
    e = F.exp(combine(x, beta))
    dead = F.col("status") == 1
    parts: dict[str, Column] = {"0": e}
    if moments:
        for i in range(len(x)):
            parts[f"{i + 1}"] = e * x[i]
            for j in range(i, len(x)):
                parts[f"{i + 1}_{j + 1}"] = e * x[i] * x[j]
    aggs = [F.sum(dead.cast("int")).alias("d")]
    for k, v in parts.items():
        aggs += [F.sum(v).alias(f"n{k}"), F.sum(F.when(dead, v).otherwise(0.0)).alias(f"e{k}")]
    if moments:
        aggs += [F.sum(F.when(dead, x[i]).otherwise(0.0)).alias(f"x{i + 1}") for i in range(len(x))]
    per_time = rows.groupBy("time").agg(*aggs)
    # latest first, so that running sums are those at risk
    per_time, slice_col = quantile_slices(per_time.withColumn("_t", -F.col("time")), "_t", slices)
    return running(per_time, [], [F.col("_t")], {f"s{k}": ("sum", f"n{k}") for k in parts}, slice_col)


class CoxNull:
    """A fitted null model: coefficients and the table of people with their residuals."""

    def __init__(self, names: Sequence[str], beta: np.ndarray, residuals: DataFrame, iterations: int):
        self.names, self.beta, self.residuals, self.iterations = list(names), beta, residuals, iterations

    def coefficients(self, spark) -> DataFrame:
        rows = [(n, float(b)) for n, b in zip(self.names, self.beta)]
        return spark.createDataFrame(rows, "name string, beta double")


def cox_null(table: DataFrame, names: Sequence[str], keys: Sequence[str] = ("id",), tolerance: float = 1e-9,
             max_iterations: int = 30, slices: int = BOUNDED) -> CoxNull:
    """Cox model of (time, status) on the covariates, Efron ties, by Newton's method.

    A step is one aggregate per distinct time and one over the times; only the gradient and
    Hessian (k + k^2 numbers) come to the driver. Rows with a missing value are left out.
    """
    clean = table.select(*keys, F.col("time").cast("double").alias("time"), F.col("status").cast("int").alias("status"),
                         *[F.col(c).cast("double").alias(c) for c in names]).dropna("any")
    clean = settle(clean, "cox")  # read once per step
    k = len(names)
    beta, steps = np.zeros(k), 0
    if k:
        m = gram(clean, [F.lit(1.0), *[F.col(c) for c in names]])
        mean = m[0, 1:] / m[0, 0]
        spread = np.sqrt(np.maximum(np.diag(m)[1:] / m[0, 0] - mean ** 2, 0.0))
        scale = np.where(spread > 0, spread, 1.0)
        centred = clean.withColumns({c: (F.col(c) - F.lit(float(u))) / F.lit(float(s)) for c, u, s in zip(names, mean, scale)})
        for steps in range(1, max_iterations + 1):
            gradient, hessian = _newton_terms(centred, beta, names, slices)
            move = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            beta = beta + np.clip(move, -5.0, 5.0)
            if np.max(np.abs(move)) < tolerance:
                break
        else:
            raise ArithmeticError("the Cox null model did not converge")
    else:
        centred, scale = clean, np.ones(0)
    hazard = _hazard(centred, beta, names, slices)
    e = F.exp(combine([F.col(c) for c in names], beta))
    joined = centred.join(hazard, "time")
    resid = F.col("status") - e * (F.col("cumulative") - F.when(F.col("status") == 1, F.col("tied")).otherwise(0.0))
    residuals = joined.select(*keys, "time", "status", *names, resid.alias("resid"))
    return CoxNull(names, beta / scale, residuals, steps)


def _newton_terms(
    rows: DataFrame, beta: np.ndarray, names: Sequence[str], slices: int
) -> tuple[np.ndarray, np.ndarray]:
    k = len(names)
    t = _tie_sums(_risk_sums(rows, beta, names, True, slices))
    first = F.col("_chunk") == 0
    a0, a1, b0, b1, b2 = (F.col(n) for n in ("a0", "a1", "b0", "b1", "b2"))
    aggs = []
    for i in range(1, k + 1):
        own = F.when(first, F.col(f"x{i}")).otherwise(0.0)
        aggs.append(F.sum(own - (F.col(f"s{i}") * a0 - F.col(f"e{i}") * a1)).alias(f"g{i}"))
        for j in range(i, k + 1):
            si, sj, ei, ej = F.col(f"s{i}"), F.col(f"s{j}"), F.col(f"e{i}"), F.col(f"e{j}")
            second = F.col(f"s{i}_{j}") * a0 - F.col(f"e{i}_{j}") * a1
            square = si * sj * b0 - (si * ej + sj * ei) * b1 + ei * ej * b2
            aggs.append(F.sum(second - square).alias(f"h{i}_{j}"))
    row = t.agg(*aggs).first()
    gradient = np.array([row[f"g{i}"] for i in range(1, k + 1)], float)
    hessian = np.zeros((k, k))
    for i in range(1, k + 1):
        for j in range(i, k + 1):
            hessian[i - 1, j - 1] = hessian[j - 1, i - 1] = row[f"h{i}_{j}"]
    return gradient, hessian


def _hazard(rows: DataFrame, beta: Sequence[float], names: Sequence[str], slices: int) -> DataFrame:
    """Per time: cumulative baseline hazard and the part a tied death does not carry."""
    grid = _risk_sums(rows, beta, names, False, slices)
    jumps = _tie_sums(grid).groupBy("time").agg(F.sum("a0").alias("jump"), F.sum("a1").alias("tied"))
    per_time = grid.select("time").join(jumps, "time", "left").fillna(0.0)
    per_time, slice_col = quantile_slices(per_time, "time", slices)
    total = running(per_time, [], [F.col("time")], {"cumulative": ("sum", "jump")}, slice_col)
    return total.select("time", "cumulative", "tied")


def cox(dosages: DataFrame, null: CoxNull, keys: Sequence[str] = ("id",), saddlepoint: bool = True,
        cutoff: float = 2.0) -> DataFrame:
    """Score test of each variant against a Cox null model.

    Output: marker_id, n, maf, stat, z, pval_norm, pval (log10) and method. For |z| above the
    cutoff the p-value comes from a saddlepoint approximation on the residuals (Bi et al.
    2020), over everyone whose dosage is above zero; ``method`` says "saddlepoint", or "normal"
    up to the cutoff and where the statistic is beyond what the residuals can reach.
    ``null`` may hold several rows per id (two parents of one genotype).
    """
    people = People(null.residuals, list(keys), "resid", null.names)
    if saddlepoint:
        dosages = settle(dosages.select("marker_id", "id", "dosage").filter("dosage IS NOT NULL"), "dosages")  # summed, then the tails
    per_marker = _complete(_long_sums(dosages, people), people)
    covered = sum((F.col(f"g{i}") * F.lit(float(t)) for i, t in enumerate(people.q_target)), F.lit(0.0))
    variance = (people.yy - people.y_total ** 2 / people.n) / (people.n - 1)
    rows = per_marker.withColumn("stat", F.col("gy") - covered)
    rows = rows.withColumn("z", F.col("stat") / F.sqrt(F.lit(float(variance)) * F.col("rest")))
    rows = rows.withColumn("maf", F.least("freq", 1 - F.col("freq")))
    rows = rows.withColumn("pval_norm", log10_normal_two_sided(F.col("z")))
    if not saddlepoint:
        return rows.select("marker_id", "n", "maf", "stat", "z", "pval_norm")
    tail = _saddlepoint(dosages, people, rows.filter(F.abs("z") > cutoff), float(variance))
    out = rows.join(tail, "marker_id", "left")
    return out.select("marker_id", "n", "maf", "stat", "z", "pval_norm", F.coalesce("spa", "pval_norm").alias("pval"),
                      F.when(F.col("spa").isNotNull(), "saddlepoint").otherwise("normal").alias("method"))


RESIDUAL_STEP = 1 / 512  # residuals and adjusted dosages are counted in bins of these widths;
DOSAGE_STEP = 1 / 1024  # the spread inside a bin enters to second order


class ResidualCgf:
    """Log moment generating function of the centred residuals and two derivatives.

    Tabulated from bins of residuals at their means. The grid reaches so far that only the
    outermost bin counts; beyond it the function is the straight line of that bin.
    """

    def __init__(self, n: np.ndarray, mean: np.ndarray, points: int = 8001):
        weight, order = n / n.sum(), np.argsort(mean)
        mean = mean - float(weight @ mean)
        ends = np.diff(mean[order])[[0, -1]] if len(mean) > 1 else np.ones(1)
        reach = max(60.0, 40.0 / max(ends.min(), RESIDUAL_STEP / 64))
        self.grid = reach * np.sinh(np.linspace(-12, 12, points)) / math.sinh(12)
        parts = []
        for lo in range(0, points, 256):
            power = self.grid[lo : lo + 256, None] * mean
            top = power.max(axis=1, keepdims=True)
            e = weight * np.exp(power - top)
            total = e.sum(axis=1)
            m1 = e @ mean / total
            parts.append((top[:, 0] + np.log(total), m1, np.maximum(e @ mean ** 2 / total - m1 ** 2, 0.0)))
        self.k0, self.k1, self.k2 = (np.concatenate(x) for x in zip(*parts))

    def __call__(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = np.clip(u, self.grid[0], self.grid[-1])
        k1 = np.interp(inside, self.grid, self.k1)
        return np.interp(inside, self.grid, self.k0) + (u - inside) * k1, k1, np.where(u == inside, np.interp(inside, self.grid, self.k2), 0.0)


def residual_cgf(people: DataFrame) -> ResidualCgf:
    """The function of the column y; it comes to the driver as binned counts.

    Residuals are bounded by the cumulative hazard, so there are a few thousand bins however
    many people there are.
    """
    bins = people.groupBy(F.floor(F.col("y") / RESIDUAL_STEP).alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean")).toPandas()
    return ResidualCgf(bins["n"].to_numpy(float), bins["mean"].to_numpy(float))


def log10_upper_normal(x: float) -> float:
    """log10 of the standard normal upper tail."""
    if x < 30:
        return math.log10(max(0.5 * math.erfc(x / math.sqrt(2)), 1e-300))
    series = 1 - 1 / x ** 2 + 3 / x ** 4 - 15 / x ** 6
    return (-0.5 * x * x - math.log(x * math.sqrt(2 * math.pi)) + math.log(series)) / math.log(10)


def saddlepoint_tail(s: float, g: np.ndarray, spread: np.ndarray, count: np.ndarray, normal: float, table: ResidualCgf) -> float:
    """log10 P(sum > |s|) + P(sum < -|s|) for carriers binned by adjusted dosage.

    ``normal`` is the variance the non-carriers add. NaN when |s| lies outside what the sum
    can reach (only where non-carriers add nothing), or at its very centre.
    """

    def cgf(t: float):
        a, b, c = table(t * g)
        # spread within a bin: second-order terms of count * K(t * g)
        value = count @ a + 0.5 * t * t * (count * spread) @ c + 0.5 * t * t * normal
        first = count @ (g * b) + t * (count * spread) @ c + t * normal
        second = count @ (g * g * c) + (count * spread) @ c + normal
        return value, first, second

    total = []
    for q in (abs(s), -abs(s)):
        side, far = math.copysign(1.0, q), 1.0
        while far < 1e12 and side * (cgf(side * far)[1] - q) < 0:
            far *= 2
        if far >= 1e12:
            return float("nan")
        lo, hi = sorted((0.0, side * far))
        t = 0.5 * (lo + hi)
        for _ in range(200):
            value, first, second = cgf(t)
            if first > q:
                hi = t
            else:
                lo = t
            newton = t - (first - q) / second if second > 0 else math.inf
            new = newton if lo < newton < hi else 0.5 * (lo + hi)
            if abs(new - t) < 1e-12 * max(1.0, abs(t)):
                t = new
                break
            t = new
        value, first, second = cgf(t)
        w = math.copysign(math.sqrt(max(2 * (t * q - value), 0.0)), t)
        v = t * math.sqrt(second)
        if w == 0 or v / w <= 0:
            return float("nan")
        total.append(log10_upper_normal(abs(w + math.log(v / w) / w)))
    top = max(total)
    return top + math.log10(sum(10 ** (x - top) for x in total))


def _saddlepoint(dosages: DataFrame, people: People, candidates: DataFrame, variance: float) -> DataFrame:
    """marker_id, spa (log10 p) for the candidate variants.

    Carriers are counted per (variant, bin of adjusted dosage) before they meet in one
    group, so a group has a bounded number of rows however many people carry the allele.
    """
    table = residual_cgf(people.rows)
    weights = [F.col(f"g{i}") for i in range(people.rank)]
    keep = candidates.select("marker_id", "stat", "rest", *weights)
    carriers = dosages.filter(F.col("dosage") > 0).select("marker_id", "id", "dosage")
    # candidates are a small share of the variants: they thin the dosages before the people join
    rows = carriers.join(keep, "marker_id").join(people.rows, "id")
    adjusted = F.col("dosage") - sum((F.col(f"g{i}") * F.col(c) for i, c in enumerate(people.columns)), F.lit(0.0))
    binned = rows.withColumn("_a", adjusted).groupBy("marker_id", F.floor(F.col("_a") / DOSAGE_STEP).alias("_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_a").alias("s"), F.sum(F.col("_a") * F.col("_a")).alias("ss"),
        F.first("stat").alias("stat"), F.first("rest").alias("rest"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy(float)
        g = pdf["s"].to_numpy(float) / n
        spread = np.maximum(pdf["ss"].to_numpy(float) / n - g ** 2, 0.0)
        others = max(float(pdf["rest"].iloc[0]) - float(pdf["ss"].sum()), 0.0) * variance
        p = saddlepoint_tail(float(pdf["stat"].iloc[0]), g, spread, n, others, table)
        return pd.DataFrame({"marker_id": [pdf["marker_id"].iloc[0]], "spa": [p]})

    kind = dosages.schema["marker_id"].dataType.simpleString()
    parts = int(dosages.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes and much work: not merged by size
    solved = binned.repartition(parts, "marker_id").groupBy("marker_id").applyInPandas(solve, schema=f"marker_id {kind}, spa double")
    return solved.withColumn("spa", F.when(~F.isnan("spa"), F.col("spa")))
