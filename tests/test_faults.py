"""Nulls, repeats, pairs and magnitudes that once gave wrong rows."""

from datetime import date

import pytest

from cohortspark.operators.sampling import stratified_sample
from cohortspark.plans import clusters, features, records, variants


def test_known_p_values_come_first(spark):
    rows = [("t", "rs1", "A", "C", "chr1", 1, 2, 0.1, None, 7.0, 2.0, 0.5), ("t", "rs1", "A", "C", "chr1", 1, 2, 0.1, -9.0, 3.0, 6.0, 0.5)]
    df = spark.createDataFrame(rows, "trait string, marker_id string, allele1 string, allele2 string, chrom string, start_pos int, end_pos int, freq double, pval double, estim double, score double, std_err double")
    got = variants.assoc_wide(df, {"t": ["pval", "beta"]}, "t").first()
    assert (got["t_pval"], got["t_beta"]) == (-9.0, 3.0)
    top = df.select("marker_id", "allele1", "allele2", "chrom", "start_pos", "end_pos").distinct()
    got = variants.attach_results(top, df, ["t"]).first()
    assert (got["t_pval"], got["t_z"]) == (-9.0, 6.0)


def test_onset_is_one_event(spark):
    events = spark.createDataFrame(
        [(1, 50.0, None, "E11", "icd10"), (1, 60.0, date(2001, 1, 1), "E11", "icd10"), (2, None, date(1999, 1, 1), "E11", "icd10"), (2, 70.0, date(2002, 1, 1), "E11", "icd10")],
        "id int, age double, date date, icd string, icd_version string")
    dictionary = spark.createDataFrame([("E11", 1, "diabetes", "icd10")], "icd string, subs int, cohort string, icd_version string")
    got = {r["id"]: (r["age"], r["date"]) for r in records.disease_onset(events, dictionary).collect()}
    assert got == {1: (50.0, None), 2: (70.0, date(2002, 1, 1))}


@pytest.mark.parametrize("slices", [1, 4])
def test_window_means_of_nulls_repeats_and_magnitudes(spark, slices):
    values = [(1, 10.0, 4.0), (1, 11.0, None), (2, 10.0, 1e27), (2, 50.0, 4e-13), (2, 51.0, 2e-13), (3, 10.0, None), (4, 10.0, float("nan")), (4, 11.0, -3.0)]
    tracks = spark.createDataFrame([(i, "lab", t, v) for i, t, v in values], "id int, track string, ts double, value double")
    anchors = spark.createDataFrame([(1, 12.0), (1, 12.0), (2, 12.0), (2, 52.0), (3, 12.0), (4, 12.0), (5, 12.0)], "id int, t double")
    rows = features.window_values(anchors, tracks, {"lab": (-5.0, 0.0)}, slices).collect()
    got = {(r["id"], r["t"]): (r["size"], r["avg"]) for r in rows}
    assert len(rows) == len(got) == 6
    assert got[1, 12.0] == (2, 4.0) and got[3, 12.0] == (1, None) and got[4, 12.0] == (2, -3.0) and got[5, 12.0] == (0, None)
    assert got[2, 12.0] == (1, pytest.approx(1e27)) and got[2, 52.0] == (2, pytest.approx(3e-13))


def test_many_centres(spark):
    n = 2 * clusters.CHUNK + 500
    centres = spark.range(n).selectExpr("cast(id as int) AS clust", "cast(id as double) AS a", "cast(0 as double) AS b")
    points = spark.createDataFrame([(1, 1234.2, 0.0), (2, 0.5, 0.0), (3, None, 3.0), (4, None, None)], "id int, a double, b double")
    got = {r["id"]: (r["clust"], r["dist"]) for r in clusters.nearest_centroid(points, centres, ["a", "b"]).collect()}
    assert got[1] == (1234, pytest.approx(0.2)) and got[2] == (0, pytest.approx(0.5)) and got[3][0] == 0 and got[4] == (None, None)


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 AS g")
    a = {tuple(r) for r in stratified_sample(df.repartition(1), ["g"], ["id"], 7, "s").collect()}
    b = {tuple(r) for r in stratified_sample(df.repartition(37), ["g"], ["id"], 7, "s").collect()}
    assert a == b and len(a) == 21
