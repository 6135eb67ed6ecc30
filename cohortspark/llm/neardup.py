"""Near duplicates by a chosen-path set similarity join.

A document's set holds its distinct word shingles. Equal sets collapse into classes first.
Then several independent trees branch the classes: at each level a class follows its
minwise tokens under two hashes of that level (one at the first level). Nodes that hold a single class, or one component of
links found so far, end (first every node's smallest class is compared with one class of each
other component, so that groups of copies become one component). Small nodes end too, and so do
nodes that few classes share with one large component: their classes are compared exhaustively,
across components only, on digests of their sets. A digest holds all shingles of a set of usual
size, so that few pairs below the threshold go on, and a node gives a spanning forest of its
certain links instead of all of them. Nodes still mixed at the last level are compared in tiles.
Every pair is confirmed on the full sets. Two sets of similarity 0.75 stay together in one tree
down to depth 5 with probability 0.67 (0.24 with one hash a level), so that 8 of the 16 trees
that share no hash all lose them with probability 0.0001.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.components import components
from cohortspark.llm.textops import U64, arrow_limits, binary_rows, column_bytes, each_block, mix, signed
from cohortspark.sources.stored import last_written, lifetime, settle

TREES, LEVELS = 16, 5
STAR_TREES = 2  # trees whose nodes are tried first, smallest class against the others
SMALL = 512  # classes in a node that is compared exhaustively
EXTRA = 256  # further minwise values of one byte each, for comparing only (a multiple of 4)
TILE = 512  # rows of a tile in a node that stays large
DIGEST = 1024  # shingles in a digest; of a larger set those below a power of two stay
COLUMNS = 4096  # distinct shingles that a product of digests takes at a time
SLACK = 3  # shingles of one pair whose 32-bit values may meet by chance in a certain link


def _shingles(words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows, in row order, and the bounds of each row."""
    h = words.hashes(lower=True)
    first = words.first
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(len(h), U64)
    if len(h):
        for j in range(width):
            out *= U64(0x2545F4914F6CDD1D)
            out[: len(h) - j] += h[j:]
        out = mix(out, 1)
    row = np.repeat(np.arange(len(n)), count)
    picked = out[first[:-1][row] + (np.arange(len(row)) - bounds[row])] if len(row) else np.zeros(0, U64)
    for i in np.flatnonzero((n > 0) & (n < width)):  # shorter: the whole sequence is one shingle
        acc = U64(int(n[i]))
        for x in h[first[i] : first[i + 1]]:
            acc = mix(np.array([acc], U64) * U64(0x2545F4914F6CDD1D) + x, 2)[0]
        picked[bounds[i]] = acc
    return picked, bounds


def _distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values sorted, without repeats."""
    keep = np.ones(len(values), bool)
    for i in range(len(bounds) - 1):
        a, b = bounds[i], bounds[i + 1]
        if b - a > 1:
            values[a:b].sort()
            keep[a + 1 : b] = values[a + 1 : b] != values[a : b - 1]
    kept = np.concatenate([[0], np.cumsum(keep)])
    return values[keep], kept[bounds]


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, words in each_block(texts):
        yield lo, hi, *_distinct(*_shingles(words, width))


def _signatures(values: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """k minwise values (32 bit) for each row; rows without values get zeros."""
    rows = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, k), np.uint32)
    if len(rows):
        starts = bounds[:-1][rows]
        rng = np.random.default_rng(11)
        odd = rng.integers(1, 2**63, k, dtype=np.int64).view(U64) * U64(2) + U64(1)
        for j in range(k):
            out[rows, j] = np.minimum.reduceat((((values ^ (values >> U64(29))) * odd[j]) >> U64(32)).astype(np.uint32), starts)
    return out


def _sketches(values: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """k minwise values, then the low bytes of ``EXTRA`` more, four in a column."""
    whole = _signatures(values, bounds, k + EXTRA)
    return np.hstack([whole[:, :k], np.ascontiguousarray(whole[:, k:].astype(np.uint8)).view(np.uint32)])


def sketch(docs: DataFrame, id_col: str, text_col: str, width: int, k: int) -> DataFrame:
    """(id, n_shingles, f1, f2, sig): the set's size, a 128-bit fingerprint and its signature."""

    def run(batches):
        for batch in batches:
            ids, n, f1, f2, sig = batch.column(0), [], [], [], []
            for _, _, values, bounds in shingle_sets(batch.column(1), width):
                size = np.diff(bounds)
                for to, seed in ((f1, 5), (f2, 6)):
                    sums = np.zeros(len(values) + 1, U64)
                    np.cumsum(mix(values, seed), out=sums[1:])
                    to.append(sums[bounds[1:]] - sums[bounds[:-1]])
                n.append(size)
                sig.append(_sketches(values, bounds, k))
            if not len(ids):
                continue
            sig = np.concatenate(sig)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.concatenate(n).astype(np.int64)), signed(np.concatenate(f1)), signed(np.concatenate(f2)),
                 binary_rows(sig.reshape(-1), np.arange(len(ids) + 1) * sig.shape[1])],
                ["id", "n_shingles", "f1", "f2", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "id long, n_shingles long, f1 long, f2 long, sig binary")


def _digest(values: np.ndarray) -> np.ndarray:
    """The lower halves of a set's hashes, sorted; of a set beyond ``DIGEST`` those below 2**32 / 2**rate."""
    return np.unique(values.astype(np.uint32)[values.astype(np.uint32) <= np.uint32((1 << (32 - _rate(len(values)))) - 1)])


def _rate(size: int) -> int:
    return (-(-max(int(size), 1) // DIGEST) - 1).bit_length()


def _set_rows(docs: DataFrame, width: int) -> DataFrame:
    """(id, text) to (id, set, digest): the distinct shingle hashes, sorted, as 8-byte values, and their digest."""

    def run(batches):
        for batch in batches:
            sets, digests = [], []
            for _, _, values, bounds in shingle_sets(batch.column(1), width):
                sets.append(binary_rows(values, bounds))
                digests += [_digest(values[lo:hi]).tobytes() for lo, hi in zip(bounds[:-1], bounds[1:])]
            if sets:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.concat_arrays(sets), pa.array(digests, pa.binary())], ["id", "set", "digest"])

    return docs.mapInArrow(run, "id long, set binary, digest binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity."""

    def run(batches):
        for batch in batches:
            (da, oa), (db, ob) = column_bytes(batch.column(2)), column_bytes(batch.column(3))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = da[oa[i] : oa[i + 1]].view(U64), db[ob[i] : ob[i + 1]].view(U64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                common = int((y[at] == x).sum())
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select([0, 1]).filter(pa.array(keep))

    left = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _paths(reps: DataFrame, trees: int, levels: int, *columns: str) -> DataFrame:
    """One row per tree: its minwise tokens, level by level, four bytes each, then those of the next tree."""
    own = [F.substring("sig", t * levels * 4 + 1, levels * 4) for t in range(trees)]
    path = F.array(*[F.concat(own[t], own[(t + 1) % trees]) for t in range(trees)])
    return reps.select(*columns, F.posexplode(path).alias("tree", "path"))


def _token(depth: int):
    return F.substring("path", 4 * depth + 1, 4)


def _likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that may reach the similarity: sizes allow it and the signatures agree to within six deviations."""
    whole = a.shape[1] - EXTRA // 4
    k = whole + EXTRA
    p = percent / 100
    need = max(0.0, p - 6 * (p * (1 - p) / k) ** 0.5) * k
    fits = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    a, b = a[fits], b[fits]
    fits[fits] = (a[:, :whole] == b[:, :whole]).sum(axis=1) + (a[:, whole:].view(np.uint8) == b[:, whole:].view(np.uint8)).sum(axis=1) >= need
    return fits


def _stars(paths: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Possible pairs of each node's smallest class with one class of every other component.

    ``paths`` are rows (node, id, comp); nodes of one component make no pairs.
    """
    nodes = paths.groupBy("node").agg(F.min("id").alias("a"), F.min_by("comp", "id").alias("ac"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    firsts = paths.groupBy("node", "comp").agg(F.min("id").alias("b"))
    pairs = firsts.join(nodes, "node").filter("comp <> ac").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = reps.select(F.col("id").alias("a"), F.col("sig").alias("sa"), F.col("n_shingles").alias("na"))
    right = reps.select(F.col("id").alias("b"), F.col("sig").alias("sb"), F.col("n_shingles").alias("nb"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (column_bytes(batch.column(i))[0].view(np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
                na, nb = (batch.column(i).to_numpy() for i in (4, 5))
                yield batch.select([0, 1]).filter(pa.array(_likely(a, b, na, nb, percent)))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a long, b long")


def _common(digests: list[np.ndarray], lower: np.ndarray, upper: np.ndarray, rates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common and united shingles of the digests ``lower`` with the digests ``upper``, at the coarser rate of the two."""
    common = np.zeros((len(lower), len(upper)), np.float32)
    united = np.zeros((len(lower), len(upper)), np.float32)
    row = np.repeat(np.arange(len(digests)), [len(d) for d in digests])
    values = np.concatenate(digests)
    for rate in np.unique(rates):
        some = values <= np.uint32((1 << (32 - int(rate))) - 1)
        r, v = row[some], values[some]
        size = np.bincount(r, minlength=len(digests)).astype(np.float32)
        _, column, times = np.unique(v, return_inverse=True, return_counts=True)
        shared = times[column] > 1  # a shingle of one row alone is common to no two
        r, column = r[shared], column[shared]
        _, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        r, column = r[order], column[order]
        both = np.zeros_like(common)
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            i, j = np.searchsorted(column, [lo, lo + COLUMNS])
            held = np.zeros((len(digests), COLUMNS), np.float32)
            held[r[i:j], column[i:j] - lo] = 1
            both += held[lower] @ held[upper].T
        here = np.maximum(rates[lower][:, None], rates[upper][None, :]) == rate
        common[here] = both[here]
        united[here] = (size[lower][:, None] + size[upper][None, :] - both)[here]
    return common, united


def _forest(likely: np.ndarray, sure: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """Rows to confirm: a spanning forest of the sure links between components, and the likely pairs it leaves apart."""
    label, out = np.full(len(comp), -1), []
    for start in range(len(comp)):
        if label[start] >= 0:
            continue
        found = comp == comp[start]
        label[found] = start
        waiting = list(np.flatnonzero(found))
        while waiting:
            i = waiting.pop()
            near = np.flatnonzero(sure[i] & (label < 0))
            for c, j in zip(*np.unique(comp[near], return_index=True)):
                out.append((i, int(near[j])))
                new = np.flatnonzero(comp == c)
                label[new] = start
                waiting.extend(new)
    i, j = np.nonzero(np.triu(likely & (label[:, None] != label[None, :])))
    return out + list(zip(i.tolist(), j.tolist()))


def _possible(digests: list[np.ndarray], n: np.ndarray, side: np.ndarray, comp: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of a node's rows to confirm. Rows of side 0 meet each other, those of side 1 the rows of side 2."""
    p, rates = percent / 100, np.array([_rate(x) for x in n])
    likely, sure = (np.zeros((len(n), len(n)), bool) for _ in range(2))
    lower, upper = (np.flatnonzero(side == s) for s in ((0, 0) if (side == 0).any() else (1, 2)))
    common, united = _common(digests, lower, upper, rates)
    whole = np.maximum(rates[lower][:, None], rates[upper][None, :]) == 0
    # two shingles of one set with one value cost a common one; a sample may be off by six deviations
    at_least = np.where(whole, p * united - SLACK, (p - 6 * np.sqrt(p * (1 - p) / np.maximum(united, 1))) * united - SLACK)
    a, b = n[lower][:, None], n[upper][None, :]
    apart = (comp[lower][:, None] != comp[upper][None, :]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
    place = np.ix_(lower, upper)
    likely[place] = apart & (common >= at_least)
    sure[place] = apart & whole & (100 * (common - SLACK) >= percent * (united + SLACK))
    return _forest(likely | likely.T, sure | sure.T, comp)


def _node_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """(node, side, id, comp, n_shingles, digest), to pairs across components that are to be confirmed.

    Rows of a node are together and at most ``SMALL`` or twice ``TILE``.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(rows: list[tuple]) -> list[dict]:
        _, side, ids, comp, n, digests = zip(*rows)
        if len(set(comp)) < 2 or len(set(side)) < 2 and 0 not in side:
            return []
        pairs = _possible([np.frombuffer(d, np.uint32) for d in digests], np.array(n), np.array(side), np.array(comp), percent)
        return [{"a": min(ids[i], ids[j]), "b": max(ids[i], ids[j])} for i, j in pairs]

    def run(batches):
        node, rows = None, []
        for batch in batches:
            out = []
            for row in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                if row[0] != node and rows:
                    out += compare(rows)
                    rows = []
                node = row[0]
                rows.append(row)
            yield pa.RecordBatch.from_pylist(out, schema)
        if rows:
            yield pa.RecordBatch.from_pylist(compare(rows), schema)

    return (nodes.select("node", "side", "id", "comp", "n_shingles", "digest").repartition("node")
            .sortWithinPartitions("node", "id").mapInArrow(run, "a long, b long"))


def _tiles(large: DataFrame) -> DataFrame:
    """Nodes (node, side, id) in which every row of a large node meets every row of another component once.

    ``main`` is the node's largest component, of ``most`` rows: its rows meet the others only, so
    each stands in one tile for every tile of the others.
    """
    others, mains = (F.ceil(x / TILE).cast("int") for x in (F.col("size") - F.col("most"), F.col("most")))
    rows = large.withColumns({"others": others, "mains": mains, "inside": F.col("comp") == F.col("main")})
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("id"), F.when(F.col("inside"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda kind, side, x, y: F.struct(F.xxhash64("node", F.lit(kind), x, y).alias("node"), F.lit(side).alias("side"))
    tile = F.col("tile")
    inner = F.transform(upto("others"), lambda t: F.struct(
        F.xxhash64("node", F.lit(0), F.least(tile, t), F.greatest(tile, t)).alias("node"),
        F.when(tile == t, 0).when(tile < t, 1).otherwise(2).alias("side")))
    places = F.when(F.col("inside"), F.transform(upto("others"), lambda t: place(1, 1, t, tile))).otherwise(
        F.concat(inner, F.transform(upto("mains"), lambda t: place(1, 2, tile, t))))
    return rows.select("id", F.explode(places).alias("place")).select("place.node", "place.side", "id")


def _branches(reps: DataFrame, trees: int, levels: int, percent: int) -> DataFrame:
    """Pairs to confirm across components (column ``comp``) from the leaves of all trees.

    Each level's mixed nodes are written: its leaves and the next level read them, and no plan holds all levels.
    """
    live = _paths(reps, trees, levels, "id", "comp").withColumn("node", F.xxhash64("tree", _token(0)))
    found = None
    for depth in range(1, levels + 1):
        size = (live.groupBy("node", "comp").agg(F.count("*").alias("most")).groupBy("node")
                .agg(F.sum("most").alias("size"), F.max_by("comp", "most").alias("main"), F.max("most").alias("most")))
        mixed = settle(live.join(size.filter("most < size"), "node"), "nodes")
        small = F.col("size") <= SMALL
        ends = small | (F.col("size") - F.col("most") <= TILE) | F.lit(depth == levels)
        leaf = mixed.filter(small).select("node", F.lit(0).alias("side"), "id")
        leaf = leaf.union(_tiles(mixed.filter(ends & ~small)))
        found = leaf if found is None else found.union(leaf)
        if depth < levels:
            both = F.array(*[F.xxhash64("node", F.lit(i), _token(depth + i * levels)) for i in range(2)])
            live = mixed.filter(~ends).select("id", "comp", "tree", "path", F.explode(both).alias("node"))
    return _node_pairs(found.join(reps.select("id", "comp", "n_shingles", "digest"), "id"), percent).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75,
    trees: int = TREES, levels: int = LEVELS,
) -> DataFrame:
    """``(id_col, n_shingles, component_id, kept)``, one row per document.

    Texts are lower-cased in A-Z and split at white space; a text with fewer than ``width``
    words is one shingle, a null or wordless one has an empty set and links with nothing.
    Documents link when ``100 * |intersection| >= percent * |union|``. ``component_id`` is
    the smallest id reachable over links; ``kept`` marks it. Rows of one id and text are one
    document and get the same values. A null id is never smallest: its row follows the documents of
    equal set, or else stands alone, with a null component, and is kept. Other columns are ignored.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    with lifetime(spark) as keep:  # sets, nodes and pairs go when the components are known
        table = settle(sketch(docs, id_col, text_col, width, trees * levels), "sketches")
        keep.append(last_written(spark))
        reps = (table.filter("n_shingles > 0").groupBy("f1", "f2", "n_shingles")
                .agg(F.min_by(F.struct("id", "sig"), "id").alias("r")).select("f1", "f2", "n_shingles", "r.id", "r.sig"))
        classes = settle(reps, "classes")
        keep.append(last_written(spark))
        reps = classes.select("id", "n_shingles", "sig")
        # full sets of the classes that stand beside another one in several trees: a pair of
        # similarity 0.75 misses a quarter of 16 trees with probability 4e-6
        paths = _paths(reps, trees, levels, "id").select("id", F.xxhash64("tree", _token(0)).alias("node"), "tree")
        shared = paths.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        beside = paths.join(shared, "node").groupBy("id").agg(F.count("*").alias("trees")).filter(F.col("trees") >= max(1, trees // 4)).select("id")
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        sets = settle(_set_rows(texts.join(beside, "id", "left_semi"), width), "sets")
        reps = settle(reps.join(sets.select("id"), "id", "left_semi"), "beside")
        links = None
        for some in (STAR_TREES, trees):  # most links come from few trees; then what still lies apart
            parts = None if links is None else components(links)
            comp = F.col("id") if parts is None else F.coalesce("component", "id")
            reps_ = (reps if parts is None else reps.join(parts, "id", "left")).withColumn("comp", comp).drop("component")
            nodes = _paths(reps_, some, levels, "id", "comp").select("id", "comp", F.xxhash64("tree", _token(0)).alias("node"))
            found = settle(_confirm(settle(_stars(nodes, reps, percent), "stars"), sets, percent), "confirmed")
            links = found if links is None else links.union(found)
        branched = reps.join(components(links), "id", "left").select("id", "sig", "n_shingles", F.coalesce("component", "id").alias("comp"))
        branched = settle(branched.join(sets.select("id", "digest"), "id"), "components")
        more = _confirm(settle(_branches(branched, trees, levels, percent), "leaves"), sets, percent)
        final = components(links.union(more))
        keep.append(last_written(spark))
    classes = classes.join(final, "id", "left").select("f1", "f2", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    out = table.join(classes, ["f1", "f2", "n_shingles"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
