"""Registered corpus queries against their SQL, and the pipeline against its operators."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check import compare, duck
from cohortspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, folder, name):
    _, _, same, note = compare(spark, duck(folder), folder, name, queries.QUERIES[name], queries.ORACLES[name])
    assert same, note


def test_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names


def test_pipeline(spark, folder):
    """Each stage's decisions take effect, and what it keeps is what its operator says."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        if name == "packing":
            assert {r[0] for r in docs.select("doc_id").distinct().collect()} == ids
            break
        docs = spark.createDataFrame(docs.toArrow(), docs.schema)
        assert docs.columns == columns
        left = {r[0] for r in docs.select("doc_id").collect()}
        if name == "toxicity":
            scores = queries.QUERIES["op10_toxicity"](spark, folder)
            assert left == {r[0] for r in scores.filter("predicted = 0").select("doc_id").collect()} and left < ids
        elif name == "near_dedup":
            from test_duplicates import shingles, union
            sets = {r[0]: shingles(r[1]) for r in before.select("doc_id", "text").collect()}
            links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
            assert left == {i for i, c in union(links, sets).items() if i == c}
        elif name == "decontamination":
            held = queries.decontaminate.contaminated(before, queries.table(spark, folder, "benchmark"))
            assert left == ids - {r[0] for r in held.select("doc_id").collect()}
        else:
            assert left == ids
        ids = left


def test_stages_take_odd_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    odd = docs.union(docs.limit(3)).unionByName(docs.limit(2).selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars")).unionByName(
        docs.limit(2).selectExpr("doc_id + 1000000 doc_id", "cast(null as string) text", "cast(null as string) lang", "source", "n_chars")).selectExpr("*", "1 AS id", "'c' AS component_id")
    empty = odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        for table in (odd, empty):
            out = stage(spark, table, folder)
            assert out.count() <= table.count() or name == "packing"
            assert name == "packing" or out.columns == table.columns
