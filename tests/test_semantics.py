"""Missing values, orders and the other easy mistakes."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from cohortspark.functions import dates, nulls, numeric
from cohortspark.operators.keys import assert_unique, exclude, first_per_key, natural_join
from cohortspark.operators.ordered import quantiles, ranked, rolling_mean, running, with_ranks
from cohortspark.operators.sampling import ntile, row_numbers, stratified_sample
from cohortspark.plans import clusters, labs, outcomes, records, scores
from cohortspark.sources import stored, wide


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_join_matches_null_with_null(spark):
    a = spark.createDataFrame([(1, None), (2, 5)], "id int, k int")
    b = spark.createDataFrame([(1, None, "x"), (2, 6, "y")], "id int, k int, v string")
    assert rows(natural_join(a, b), "id", "k", "v") == sorted([(1, None, "x"), (2, 5, None)], key=str)
    assert natural_join(a, b, "full").count() == 3


def test_ifelse_keeps_null(spark):
    df = spark.createDataFrame([(None,), (True,), (False,)], "c boolean")
    assert [r[0] for r in df.select(nulls.ifelse(F.col("c"), 1, 0)).collect()] == [None, 1, 0]


def test_first_per_key_puts_null_last_and_breaks_ties(spark):
    df = spark.createDataFrame([(1, None, "n"), (1, 3, "b"), (1, 3, "a"), (2, None, "z")], "id int, t int, v string")
    assert rows(first_per_key(df, ["id"], ["t", "v"]), "id", "t", "v") == [(1, 3, "a"), (2, None, "z")]
    assert rows(first_per_key(df, ["id"], [("t", "desc"), "v"]), "id", "v") == [(1, "a"), (2, "z")]


def test_exclude_keeps_null_keys(spark):
    df = spark.createDataFrame([(1,), (None,)], "id int")
    assert exclude(df, spark.createDataFrame([(1,)], "id int")).count() == 1


def test_age_uses_365_days(spark):
    df = spark.createDataFrame([(datetime.date(2001, 1, 1),)], "d date")
    age = df.select(dates.age_on(F.col("d"), dates.birth_date(F.lit(2000), F.lit(1)))).first()[0]
    assert age == 366 / 365


def test_strict_mean(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, 3.0)], "k int, v double")
    assert rows(df.groupBy("k").agg(nulls.mean_strict(F.col("v")).alias("m")), "k", "m") == [(1, None), (2, 3.0)]


def test_parents_keep_sentinels_unless_told(spark):
    raw = spark.createDataFrame([(1, 70.0, -3.0)], "eid int, m_f3526_0_0 double, m_f3526_1_0 double")
    assert records.parents_survival(raw).first()["mfollow_time"] == -3.0
    assert records.parents_survival(raw, sentinels=[-3.0]).first()["mfollow_time"] == 70.0
    assert records.parents_survival(raw).first()["fdead"] is False


def test_prefix_needs_the_whole_prefix(spark):
    dx = spark.createDataFrame([(1, "25", 9), (2, "2501", 9), (3, "2501", 10), (4, "428", 9)], "id int, icd string, icd_version int")
    codes = spark.createDataFrame([("250", 1, "d", 9), ("42", 1, "a", 9), ("2501", 0, "e", 10)], "icd string, subs int, cohort string, icd_version int")
    assert rows(records.prefix_join(dx, codes), "id", "cohort") == [(2, "d"), (4, "a")]
    assert rows(records.match_codes(dx, codes), "id", "cohort") == [(2, "d"), (3, "e"), (4, "a")]


def test_unit_rules(spark):
    lab = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, 10.0), (4, 10.0), (5, 10.0)], "field int, value double")
    rules = spark.createDataFrame([(1, "*0.5"), (2, "/ 4"), (3, "-3"), (4, ""), (5, "* 1e2")], "field int, action string")
    assert rows(labs.unit_fix(lab, rules), "field", "value") == [(1, 5.0), (2, 2.5), (3, 7.0), (4, 10.0), (5, 1000.0)]


def test_text_labs_are_dropped(spark):
    raw = spark.createDataFrame([(1, "<5", "7.5")], "eid int, a_f1_0_0 string, a_f1_1_0 string")
    assert rows(wide.long_fields(raw, [1]), "value", "timepoint") == [("7.5", 1), ("<5", 0)]
    v = spark.createDataFrame([(1, 1, 50.0, 1)], "id int, sex int, age double, timepoint int")
    assert rows(records.lab_values(raw, [1], v), "value", "age") == [(7.5, 50.0)]


def test_bucket_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (1.0,), (-0.1,), (None,)], "x double")
    got = [r[0] for r in df.select(numeric.bucketize(F.col("x"), [0, 0.1, 1.0], include_lowest=True)).collect()]
    assert got == [1, 2, 2, None, None]
    got = [r[0] for r in df.select(numeric.bucketize(F.col("x"), [0, 0.1, 1.0])).collect()]
    assert got == [1, 2, None, None, None]
    label = numeric.interval_label(numeric.bucketize(F.col("x"), [0, 0.1, 1.0]), [0, 0.1, 1.0])
    assert [r[0] for r in df.select(label).collect()] == ["[0,0.1)", "[0.1,1)", None, None, None]


def test_interpolation_is_null_outside(spark):
    knots = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (1.0, 10.0))])
    df = spark.createDataFrame([(-0.1,), (0.0,), (0.25,), (1.0,), (1.1,), (None,)], "x double")
    assert [r[0] for r in df.select(numeric.interpolate(F.col("x"), knots)).collect()] == [None, 0.0, 2.5, 10.0, None, None]


def test_centroid_with_missing_coordinates_and_ties(spark):
    df = spark.createDataFrame([(1, 0.0, None), (2, 0.5, 0.5), (3, None, None)], "id int, a double, b double")
    c = spark.createDataFrame([(2, 0.0, 0.0), (1, 1.0, 1.0)], "clust int, a double, b double")
    got = rows(clusters.nearest_centroid(df, c, ["a", "b"]), "id", "clust", "dist")
    assert got == sorted([(1, 2, 0.0), (2, 1, pytest.approx(0.5**0.5)), (3, None, None)], key=lambda r: str(r[0]))


def test_phenotype_order_of_steps(spark):
    pop = spark.createDataFrame([(1, 1, 55, None), (1, 1, 65, 0.2), (2, 1, 55, 0.4)], "id int, sex int, age int, diabetes double")
    got = rows(scores.disease_phenotype(pop, ["diabetes"]), "id", "age", "score")
    assert got == [(1, 55, 1.0), (2, 55, 0.4)]  # the nearer age is taken before its missing score is filled


def test_sick_at_exposure_is_unknown_without_disease(spark):
    p = spark.createDataFrame([(1, 60.0, 100.0)], "id int, exp_age double, exp_date double")
    none = spark.createDataFrame([], "id int, cohort string, age double, date date")
    row = outcomes.disease_outcomes(p, none, F.lit(datetime.date(1971, 1, 1)), ["ckd"]).first()
    assert row["sick"] is False and row["sick_at_exp"] is None and row["disease_follow_time"] == 265.0


def _left(spark):
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    return {n for n in os.listdir(root) if n.startswith(("mine", "other"))}


def test_equal_tables_are_written_once_and_dropped(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    read = lambda: spark.read.parquet(path).selectExpr("id * 2 AS x")
    with stored.lifetime(spark) as keep:
        first = stored.reuse(read(), "mine")
        assert stored.reuse(read(), "mine").inputFiles() == first.inputFiles() and len(_left(spark)) == 1
        assert stored.reuse(read().filter("x > 2"), "mine").count() == 3 and len(_left(spark)) == 2
        spark.range(7).write.mode("overwrite").parquet(path)  # other files: other content
        assert stored.reuse(read(), "mine").count() == 7
        kept = stored.settle(spark.range(2), "other")
        keep.append(kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://"))
    assert len(_left(spark)) == 1 and kept.count() == 2
    again = stored.reuse(read(), "mine")
    assert again.count() == 7
    stored.release(spark)
    assert not _left(spark)


def test_materialize_reuses_only_finished_tables(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "t")
    assert stored.materialize(spark, build, path).count() == 3
    assert stored.materialize(spark, build, path).count() == 3 and len(calls) == 1
    (tmp_path / "t" / "_SUCCESS").unlink()
    stored.materialize(spark, build, path)
    assert len(calls) == 2


def test_unique_check(spark):
    with pytest.raises(ValueError):
        assert_unique(spark.createDataFrame([(1,), (1,)], "id int"), ["id"])


# --- results do not depend on how the data is cut --------------------------------------

@pytest.fixture(scope="module")
def skewed(spark):
    data = [("hot" if i % 3 else f"g{i % 5}", float((i * 7919) % 101), i % 2) for i in range(900)] + [("hot", None, 1)]
    return spark.createDataFrame(data, "g string, x double, w int").repartition(5)


@pytest.mark.parametrize("slices", [3, 16])
def test_ranks_do_not_depend_on_slices(skewed, slices):
    cols = ("g", "x", "n", "upto", "w_upto", "total", "w_total")
    assert rows(ranked(skewed, ["g"], "x", "w", 1), *cols) == rows(ranked(skewed, ["g"], "x", "w", slices), *cols)
    out = {"r": F.col("upto") * 1000 + F.col("n"), "s": F.col("w_upto") / F.col("w_total")}
    plain = skewed.withColumnRenamed("w", "wt")
    assert rows(with_ranks(plain, ["g"], "x", out, "wt", 1), "g", "x", "r", "s") == rows(
        with_ranks(plain, ["g"], "x", out, "wt", slices), "g", "x", "r", "s")


def test_quantiles_match_numpy(skewed):
    import numpy as np

    pdf = skewed.toPandas()
    for r in quantiles(skewed, ["g"], "x", [0.0, 0.1, 0.5, 0.93, 1.0], 7).collect():
        assert r["x"] == pytest.approx(np.quantile(pdf[pdf.g == r["g"]].x.dropna(), r["p"]))


@pytest.mark.parametrize("before", [False, True])
def test_running_kinds(spark, before):
    data = [("a", i, None if i % 3 else i * 10, (i * 37) % 11) for i in range(40)]
    df = spark.createDataFrame(data, "k string, t int, v int, m int").withColumn("sl", F.floor(F.col("t") / 7))
    spec = {"s": ("sum", "m"), "x": ("max", "m"), "l": ("last", "v")}
    cols = ("t", "s", "x", "l", "tot")
    one = running(df, ["k"], [F.col("t")], spec, None, before, {"tot": "m"})
    many = running(df, ["k"], [F.col("t")], spec, "sl", before, {"tot": "m"})
    assert rows(one, *cols) == rows(many, *cols)


def test_row_numbers_and_batches(spark):
    df = spark.range(23).select(((F.col("id") * 7) % 23).alias("k")).repartition(4)
    for slices in (1, 5):
        got = row_numbers(df, F.col("k").cast("double"), ["k"], slices=slices)
        assert rows(got, "k", "rn") == sorted([(i, i + 1) for i in range(23)], key=str)
    sizes = got.groupBy(ntile(F.col("rn"), F.col("n_rows"), 5).alias("b")).count().orderBy("b").collect()
    assert [r["count"] for r in sizes] == [5, 5, 5, 4, 4]


def test_sample_is_the_same_for_any_partitions(spark):
    df = spark.range(500).select("id", (F.col("id") % 2).alias("g"))
    pick = lambda d: rows(stratified_sample(d, ["g"], ["id"], 40, "s"), "g", "id")
    assert pick(df) == pick(df.repartition(7)) and len(pick(df)) == 80


def test_rolling_pair_mean(spark):
    df = spark.createDataFrame([(35,), (40,), (45,)], "b int")
    assert rows(rolling_mean(df, [], [F.col("b")], "b", "c"), "b", "c") == [(35, 37.5), (40, 42.5), (45, None)]


def test_level_codes(spark):
    df = spark.createDataFrame([("male",), ("female",), ("other",), (None,)], "s string")
    assert [r[0] for r in df.select(numeric.level_code(F.col("s"), ["male", "female"])).collect()] == [1, 2, None, None]
