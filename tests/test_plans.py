"""What the physical plans must not contain."""

import re

import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()
# queries whose build is an eager loop of jobs
EAGER = {"train_stitched", "train_disease", "model_score", "feature_contributions", "cox_null", "gwas_cox", "gwas_cox_both",
         "gwas_cox_plain", "markov_lifelong", "markov_disease_lifelong"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_nested_loops(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


ROW_SCALE = ["normalize_labs", "disease_onset", "feature_matrix", "window_values", "score_table", "interval_merge", "interval_nearest",
             "interval_overlap", "km_by_genotype", "assoc_wide", "stratified_sample", "diagnosis_union"]


@pytest.mark.parametrize("name", ROW_SCALE)
def test_rows_stay_spread(spark, folder, name):
    assert "Exchange SinglePartition" not in plan(QUERIES[name](spark, folder))


def test_scan_reads_only_what_it_needs(spark, folder):
    text = plan(QUERIES["disease_onset"](spark, folder))
    orders = [line for line in re.findall(r"ReadSchema: (\S+)", text) if "o_orderkey" in line]
    assert orders and all("o_totalprice" not in line for line in orders)


def test_filter_reaches_scan(spark, folder):
    from pyspark.sql import functions as F

    from cohortspark.sources.delimited import import_sumstats

    path = f"{spark.conf.get('spark.checkpoint.dir')}/sums"
    spark.range(10).select(F.concat_ws(":", F.lit("1"), "id", F.lit("A"), F.lit("C")).alias("variant"), F.lit("x").alias("t"),
                           F.lit("unused").alias("u"), (F.col("id") / 1e7).alias("p")).write.mode("overwrite").csv(path, header=True, sep="\t")
    df = import_sumstats(spark, path, "variant STRING, t STRING, u STRING, p DOUBLE", "variant", "p", ["t"])
    text = plan(df)
    assert "PushedFilters: [" in text and "LessThan(p" in text
    assert "u:string" not in text.split("ReadSchema")[1].split("\n")[0]
    assert df.count() == 10
    assert df.filter("start = 0").first()["pval"] == -400.0
