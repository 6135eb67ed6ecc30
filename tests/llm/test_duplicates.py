"""Near duplicates, repeated passages and similar vectors against brute force."""

import hashlib
import importlib
import random
from collections import Counter

import numpy as np
import pytest

from cohortspark.llm import neardup, substrings, vectors
from cohortspark.llm.components import components

FOLD = {c: c + 32 for c in range(65, 91)}


def union(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, width=5):
    w = (text or "").translate(FOLD).encode().split()
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, min(len(w), 1)))}


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [None, "", "  \n\t ", "one", "One", "one two", "a b c d e", "A B  C\nd\te"]
    base = text(120)
    for _ in range(40):  # near copies of one text, similar to each other in varying degree
        w = base.split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    out += [text(rng.randint(3, 200)) for _ in range(60)]
    out += [text(40) + " " + base[:200] + " " + text(60) for _ in range(10)]
    out += [out[20]] * 7 + ["x y z " * 900, text(30_000)]
    return list(enumerate(out, 3))


def test_near_duplicates(spark, docs):
    rows = corpus()
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = union(links, sets)
    got = neardup.near_duplicates(docs(rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(rows)
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["component_id"] == r["doc_id"]) for r in got)


def test_near_duplicates_of_odd_tables(spark, docs):
    assert neardup.near_duplicates(docs([])).count() == 0
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "q r s t u")]
    got = sorted(tuple(r)[2:] for r in neardup.near_duplicates(docs(rows)).select("doc_id", "n_shingles", "component_id", "kept").collect() if r[0] is not None)
    assert got == [(4, True), (4, True)]


def test_large_nodes_are_compared_in_tiles(spark, docs, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 4)
    monkeypatch.setattr(neardup, "TILE", 6)
    test_near_duplicates(spark, docs)


def stripped(rows, width):
    words = {i: (t or "").encode().split() for i, t in rows}
    seen = Counter(tuple(w[k : k + width]) for w in words.values() for k in range(len(w) - width + 1))
    out = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - width + 1) if seen[tuple(w[k : k + width])] > 1 for j in range(width)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = len(w), len(gone), hashlib.sha256(kept).hexdigest()
    return out


@pytest.mark.parametrize("width", [35, 9])
def test_passages(spark, docs, width):
    rows = corpus()
    line = " ".join(f"l{i}" for i in range(50))
    rng = random.Random(1)
    rows += [(1000, (line + "\n") * 5), (1001, "u " * 80), (1002, "v w " * 60), (1003, line), (1004, " ".join(f"l{i}" for i in range(45)) + " end")]
    rows += [(1100 + i, " ".join(f"z{rng.randrange(3)}" for _ in range(70))) for i in range(20)]
    got = substrings.digest(substrings.without_repeats(docs(rows), width=width)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == stripped(rows, width)
    assert len(got) == len(rows)


def test_passages_of_odd_tables(spark, docs):
    assert substrings.without_repeats(docs([])).count() == 0
    long = " ".join(f"a{i}" for i in range(60))
    got = substrings.without_repeats(docs([(1, long), (1, long), (2, None), (None, "b " + long), (5, "c"), (5, long + " d " + long)]))
    shared = " ".join(f"s{i}" for i in range(60))
    anon = " ".join(f"p{i}" for i in range(10)) + " " + shared + " " + " ".join(f"q{i}" for i in range(10))
    with_null = substrings.without_repeats(docs([(1, shared + " x y"), (2, "u v " + shared), (None, anon), (None, anon)]))
    assert {r["doc_id"]: r["n_removed"] for r in with_null.collect()} == {1: 60, 2: 60, None: 0}
    only_null = substrings.without_repeats(docs([(1, shared + " x y"), (None, anon), (None, "z " + anon)]))
    assert {r["doc_id"]: r["n_removed"] for r in only_null.collect()} == {1: 60, None: 0}
    found = {}
    for r in got.collect():
        found.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"]))
    assert found[1] == [(60, 60)] * 2 and found[2] == [(0, 0)] and found[None] == [(61, 0)] and sorted(found[5])[1][0] == 121


def test_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(700):
        v = centres[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3) if i % 11 else None))
    rows += [(700 + i, rows[5][1], rows[5][2]) for i in range(30)]
    rows += [(800, None, 1), (801, [0.0] * 16, 1), (802, [float("nan")] + [1.0] * 15, 1), (803, [None] + [1.0] * 15, 1), (804, [float("inf")] + [1.0] * 15, 1),
             (805, [1.0, 2.0], 1), (806, [2.0, 4.0], 1), (807, [], 1), (808, [1e-200] * 16, 1), (809, [3e200] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    good = {}
    for i, v, k in rows:
        if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v) / np.max(np.abs(v))
            good[i] = k, a / np.sqrt(a @ a)
    links = [(a, b) for a in good for b in good if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= 0.98]
    want, n = union(links, [r[0] for r in rows]), Counter(x for p in links for x in p)
    for tile in (vectors.TILE, 16):
        old, vectors.TILE = vectors.TILE, tile
        try:
            got = vectors.similar_vectors(df).collect()
        finally:
            vectors.TILE = old
        assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (n[i], want[i], want[i] == i) for i in want}
        assert len(got) == len(rows)


def test_vectors_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int, id string, key int"
    assert vectors.similar_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 0.0], 1, "a", 1), (1, [1.0, 0.0], 1, "a", 1), (None, [1.0, 0.0], 1, "a", 1)]
    got = vectors.similar_vectors(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 3 and [r["n_links"] for r in got if r["vec_id"] == 1] == [1, 1]


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 620)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union(pairs, {x for p in pairs for x in p})
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {i: want[i] for i in linked}


def test_no_plan_holds_all_levels_or_rounds(spark, docs, monkeypatch):
    """The driver plans one level or half round at a time (eleven joins in the leaves when it did not)."""
    held = []

    def planned(df, name, settle=neardup.settle):
        held.append((df._jdf.queryExecution().optimizedPlan().toString().count("Join "), name))
        return settle(df, name)

    monkeypatch.setattr(neardup, "settle", planned)
    monkeypatch.setattr(importlib.import_module("cohortspark.llm.components"), "settle", planned)
    texts = [f"{i} a b c d e f g h i j k l m n o p q r s t" for i in range(8)] + ["quite another text of nine words or so here", None, ""]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(list(enumerate(texts)))).collect()}
    assert got == {i: 0 if i < 8 else i for i in range(11)}
    assert max(held)[0] <= 5, held
    assert max(n for n, name in held if name in ("halves", "parts")) == 1, held
    assert {name for _, name in held} >= {"links", "halves", "parts", "nodes", "leaves"}


def test_signatures_lose_no_pair_at_the_threshold():
    rng = np.random.default_rng(1)
    n, whole = 20_000, 80
    a, b = (rng.integers(0, 1 << 32, (n, whole + 64), dtype=np.uint32) for _ in range(2))
    same = rng.random((n, whole)) < 0.75
    b[:, :whole][same] = a[:, :whole][same]
    x, y = a[:, whole:].copy().view(np.uint8), b[:, whole:].copy().view(np.uint8)
    same = rng.random(x.shape) < 0.75
    y[same] = x[same]
    b[:, whole:] = y.view(np.uint32)
    size = np.full(n, 100)
    assert neardup._likely(a, b, size, size, 75).all()
    y[:, ::2] ^= 1  # far fewer agree: such pairs need not be confirmed
    b[:, whole:] = y.view(np.uint32)
    assert not neardup._likely(a, b, size, size, 75).any()


def test_node_gives_every_link_between_components_or_a_path():
    rng = np.random.default_rng(4)
    for size in (60, 2500):  # whole digests, and samples of larger sets
        base = rng.integers(0, 1 << 63, size, dtype=np.int64).view(np.uint64)
        sets = []
        for _ in range(60):
            own = base.copy()
            at = rng.random(size) < rng.choice([0.01, 0.07, 0.13, 0.2])
            own[at] = rng.integers(0, 1 << 63, int(at.sum()), dtype=np.int64).view(np.uint64)
            sets.append(np.unique(own))
        n, comp = np.array([len(x) for x in sets]), np.arange(60) // 2
        digests = [neardup._digest(x) for x in sets]
        assert all(len(d) <= 1.2 * neardup.DIGEST for d in digests)
        for side in (np.zeros(60, int), 1 + np.arange(60) % 2):
            link = lambda i, j: 4 * len(np.intersect1d(sets[i], sets[j])) >= 3 * len(np.union1d(sets[i], sets[j]))
            meets = lambda i, j: side[i] == 0 or side[i] != side[j]
            pairs = neardup._possible(digests, n, side, comp, 75)
            assert all(comp[i] != comp[j] and meets(i, j) for i, j in pairs)
            true = [(i, j) for i in range(60) for j in range(i) if meets(i, j) and link(i, j)]
            same = [(i, j) for i in range(60) for j in range(i) if comp[i] == comp[j]]
            assert union([p for p in pairs if link(*p)] + same, range(60)) == union(true + same, range(60))


def test_branches_keep_pairs_at_depth(spark):
    rng = np.random.default_rng(2)
    n, trees, levels = 1500, 2, 5
    a = rng.integers(0, 4, (n, trees * levels), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.7, a, rng.integers(0, 4, a.shape, dtype=np.uint32))
    sig = np.hstack([np.concatenate([a, b]), np.zeros((2 * n, 64), np.uint32)])
    digest = lambda i: np.arange(i % n * 200, i % n * 200 + 100, dtype=np.uint32).tobytes()  # noqa: E731  equal for a pair only
    rows = [(i, 100, bytearray(r.tobytes()), i, bytearray(digest(i))) for i, r in enumerate(sig)]
    reps = spark.createDataFrame(rows, "id long, n_shingles long, sig binary, comp long, digest binary")
    found = {tuple(r) for r in neardup._branches(reps, trees, levels, 75).collect()}
    assert sum((i, i + n) in found for i in range(n)) >= 0.8 * n  # one hash a level: 0.7 at most
