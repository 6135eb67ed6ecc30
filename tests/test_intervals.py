"""Interval operators and time windows against brute force, with crowded places."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import intervals
from cohortspark.plans import features, variants

SCHEMA = "name string, chrom string, start_pos int, end_pos int"


def draw(seed, n, width):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        chrom = "chr1" if i % 3 else f"chr{i % 4}"
        s = int(rng.integers(0, 400) if i % 2 else rng.integers(0, 5000))
        out.append((f"{seed}_{i}", chrom, s, s + int(rng.integers(1, width))))
    return out


@pytest.fixture(scope="module")
def data(spark):
    q, t = draw(1, 150, 30), draw(2, 80, 120)
    return q, t, spark.createDataFrame(q, SCHEMA).repartition(4), spark.createDataFrame(t, SCHEMA)


@pytest.mark.parametrize("slices", [1, 8])
def test_merge(data, slices):
    _, t, _, tdf = data
    covered = {c: sorted((s, e) for _, x, s, e in t if x == c) for c in {r[1] for r in t}}
    want = []
    for c, parts in covered.items():
        cur = list(parts[0])
        for s, e in parts[1:]:
            if s > cur[1]:
                want.append((c, *cur))
                cur = [s, e]
            else:
                cur[1] = max(cur[1], e)
        want.append((c, *cur))
    got = intervals.merge(tdf, slices).select("chrom", "start_pos", "end_pos").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("slices", [1, 8])
def test_nearest(data, slices):
    q, t, qdf, tdf = data
    got = {r["name"]: r["dist"] for r in intervals.nearest(qdf, tdf.withColumnRenamed("name", "label"), "label", slices).collect()}
    for name, c, s, e in q:
        gaps = [0 if (a < e and s < b) else (s - b + 1 if b <= s else a - e + 1) for _, x, a, b in t if x == c]
        assert got[name] == (min(gaps) if gaps else None)


@pytest.mark.parametrize("crowd", [3, 100_000])
@pytest.mark.parametrize("bits", [(4,), (2, 4, 6), intervals.BIN_BITS])
def test_overlap_pairs_and_counts(data, crowd, bits):
    q, t, qdf, tdf = data
    want = sorted((a[0], b[0]) for a in q for b in t if a[1] == b[1] and a[2] < b[3] and b[2] < a[3])
    got = intervals.overlap_join(qdf, tdf.withColumnRenamed("name", "label"), ["label"], bits, crowd)
    assert sorted((r["name"], r["label"]) for r in got.collect()) == want
    counts = {r["name"]: r["n"] for r in intervals.count_overlaps(qdf, tdf, "n", 1 if crowd == 3 else 6).collect()}
    assert counts == {a[0]: sum(1 for x, _ in want if x == a[0]) for a in q}


def test_expand_stops_at_the_ends(spark):
    df = spark.createDataFrame([("a", "chr1", 10, 21)], SCHEMA)
    row = intervals.expand(intervals.centers(df), 50, {"chr1": 60}).first()
    assert (row["start_pos"], row["end_pos"]) == (0, 60)


def test_duplicate_results_keep_the_best(spark):
    rows = [("t", "rs1", "A", "C", "chr1", 1, 2, 0.1, -5.0, 1.0, 2.0, 0.5), ("t", "rs1", "A", "C", "chr1", 1, 2, 0.1, -9.0, 3.0, 6.0, 0.5),
            ("u", "rs1", "A", "C", "chr1", 1, 2, 0.1, -1.0, 4.0, 8.0, 0.5), ("u", "rs2", "A", "C", "chr1", 5, 6, 0.1, -1.0, 4.0, 8.0, 0.5)]
    df = spark.createDataFrame(rows, "trait string, marker_id string, allele1 string, allele2 string, chrom string, start_pos int, end_pos int, freq double, pval double, estim double, score double, std_err double")
    got = variants.assoc_wide(df, {"t": ["pval", "beta"], "u": ["z"]}, "t").collect()
    assert [(r["marker_id"], r["t_pval"], r["t_beta"], r["u_z"]) for r in got] == [("rs1", -9.0, 3.0, 8.0)]


@pytest.mark.parametrize("slices", [1, 9])
def test_windows_of_one_busy_patient(spark, slices):
    rng = np.random.default_rng(4)
    ev = [(1 if i % 3 else int(rng.integers(2, 6)), "lab" if i % 2 else "dx", float(rng.integers(0, 200)), float(i % 7) + 0.1) for i in range(600)]
    an = [(1 if i % 2 else int(rng.integers(2, 8)), float(rng.integers(0, 200))) for i in range(120)]
    an = sorted(set(an))
    events = spark.createDataFrame(ev, "id int, track string, ts double, value double").repartition(5)
    anchors = spark.createDataFrame(an, "id int, t double")
    got = features.window_values(anchors, events, {"lab": (-20.0, 0.0), "dx": (-5.0, 10.0)}, slices).collect()
    assert len(got) == 2 * len(an)
    for r in got:
        lo, hi = (-20, 0) if r["track"] == "lab" else (-5, 10)
        hits = sorted((ts, v) for i, k, ts, v in ev if i == r["id"] and k == r["track"] and r["t"] + lo <= ts <= r["t"] + hi)
        assert r["size"] == len(hits)
        if hits:
            assert r["avg"] == pytest.approx(sum(v for _, v in hits) / len(hits))
            assert r["earliest"] == hits[0][1] and r["dt1"] == hits[0][0] - r["t"] and r["dt2"] == r["t"] - hits[0][0]
        else:
            assert r["avg"] is None and r["earliest"] is None


def test_sparse_features_go(spark):
    rows = [(i, 1.0, "a", 1.0) for i in range(10)] + [(i, 1.0, "b", 1.0 if i < 2 else None) for i in range(10)]
    long = spark.createDataFrame(rows, "id int, t double, feature string, value double")
    assert {r["feature"] for r in features.drop_sparse(long, ["id", "t"], 0.8).collect()} == {"a"}
    assert {r["feature"] for r in features.drop_sparse(long, ["id", "t"], 0.81).collect()} == {"a", "b"}
    assert features.drop_sparse(long, ["id", "t"], 0.81).filter(F.col("feature") == "b").count() == 10


def test_long_interval_and_crowded_bin(spark):
    """One interval of 100 Mb is not exploded, and a crowded bin is joined in pieces."""
    small = spark.range(20_000).selectExpr("concat('s', id) name", "'chr1' chrom", "int(5000000 + id % 900) start_pos", "int(5000001 + id % 900) end_pos")
    large = spark.createDataFrame([("long", "chr1", 0, 100_000_000), ("gene", "chr1", 5_000_100, 5_000_200), ("off", "chr2", 0, 10)], SCHEMA).withColumnRenamed("name", "label")
    got = intervals.overlap_join(small, large, ["label"], crowd=1000)
    assert {r[0]: r[1] for r in got.groupBy("label").count().collect()} == {"long": 20_000, "gene": 20_000 // 900 * 100 + min(100, max(0, 20_000 % 900 - 100))}
    home = intervals._bins(large.withColumnRenamed("label", "x"), intervals.BIN_BITS)
    assert intervals._above(home, intervals.BIN_BITS, True).filter("x = 'long'").count() <= len(intervals.BIN_BITS) + 1
    assert intervals.overlap_join(large.withColumnRenamed("label", "name"), small.withColumnRenamed("name", "label"), ["label"]).count() == got.count()
