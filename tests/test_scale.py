"""What must not come together in the driver or in one task, however small the files are."""

import re
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cohortspark import session
from cohortspark.catalog.registry import DEALT, Inputs
from cohortspark.llm import neardup, toxicity
from cohortspark.plans import association
from cohortspark.session import tune
from cohortspark.sources import stored


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    """A folder whose customers are one file of one row group, with a null and a repeated key."""
    folder = str(tmp_path_factory.mktemp("narrow"))
    rows = spark.range(60_000).select(F.when(F.col("id") != 7, F.col("id")).alias("c_custkey"))
    rows = rows.union(spark.createDataFrame([(11,)], "c_custkey long"))
    rows.coalesce(1).write.parquet(f"{folder}/customer.parquet")
    return folder


def test_exploded_rows_are_not_broadcast_by_estimate(spark, customers):
    fx = Inputs(tune(spark), customers)
    assert "BroadcastExchange" not in fx("lifelong")._jdf.queryExecution().executedPlan().toString()


def test_unpacked_rows_are_dealt_out(spark, customers):
    score = Inputs(tune(spark), customers)("score")
    parts = [r["count"] for r in score.groupBy(F.spark_partition_id()).count().collect()]
    ids = spark.read.parquet(f"{customers}/customer.parquet")
    assert len(parts) > 1 and max(parts) < sum(parts) / 2
    assert score.filter("name = 'cvd'").select("id").distinct().count() == ids.distinct().count()


def test_tasks_grow_with_the_input(spark, customers, monkeypatch):
    """More files, more shuffle partitions than the session asks for; AQE merges the small ones."""
    monkeypatch.setattr(session, "PIECE", 1 << 10)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = Inputs(spark, customers).size
    assert size > least << 10 and Inputs(spark, f"{customers}/none").size == 0
    text = entry.queries()["fold_mean"](spark, customers)._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-size // 1024)}), ENSURE_REQUIREMENTS" in text
    tune(spark)
    fx = Inputs(spark, customers)
    assert fx("score").rdd.getNumPartitions() == -(-60_001 // DEALT) > least


def test_merged_tasks_stay_small_whatever_the_session_asks(spark):
    """A session's larger tasks took a task of the score table to 34 MB as shuffled, 772 MB in memory."""
    before = spark.conf.get(session.TASK, None)
    try:
        for asked, got in (("64MB", "8m"), (str(1 << 30), "8m"), ("4m", "4m"), ("2048kb", "2048kb"), ("65536b", "65536b"), ("1024", "1024")):
            spark.conf.set(session.TASK, asked)
            assert tune(spark).conf.get(session.TASK) == got
        spark.conf.unset(session.TASK)
        assert tune(spark).conf.get(session.TASK) == "8m"
    finally:
        spark.conf.unset(session.TASK) if before is None else spark.conf.set(session.TASK, before)


def test_sparse_tiles_grow_with_known_dosages(spark, monkeypatch):
    """Few known dosages a variant: few tiles of known dosages, the same sums as the scan of rows."""
    monkeypatch.setattr(association, "BLOCK", 64)
    monkeypatch.setattr(association, "MARKERS", 4)
    monkeypatch.setattr(association, "PIECE", 50)
    people = spark.range(640).selectExpr("id", "(id * 37) % 101 / 101D x1", "(id * 53) % 89 / 89D + sin(id) score")
    rare = spark.range(900).selectExpr("concat('r', id) marker_id", "explode(transform(array(1, 2, 3, 4), k -> (id * 31 + k * 97) % 640)) id").distinct()
    common = people.selectExpr("'c' marker_id", "id").union(people.filter("id < 64").selectExpr("explode(array('d', 'e')) marker_id", "id"))
    dosages = rare.union(common).selectExpr("marker_id", "id", "if((id + hash(marker_id)) % 50 = 0, null, cast(pmod(hash(marker_id, id), 3) as double)) dosage")
    samples = people.selectExpr("id", "id + 1 AS i")
    tiles = association.pack_dosages(dosages, samples).cache()
    known = dosages.filter("dosage is not null").count()
    assert tiles.count() < 64 and tiles.filter("cells is not null").count() > 0
    assert tiles.selectExpr("sum(length(dosages))").first()[0] <= 4 * 16 * known
    traits = people.selectExpr("id", "'a' trait", "score").union(people.filter("id % 3 = 0").selectExpr("id", "'b' trait", "x1 * score"))
    both = association.linear_traits(tiles, samples, traits, people.select("id", "x1"), ["x1"], ["a", "b"]).toPandas()
    for trait in ("a", "b"):
        own = traits.filter(F.col("trait") == trait).select("id", "score")
        want = association.linear(dosages, own, people.select("id", "x1"), ["x1"]).toPandas().sort_values("marker_id")
        got = both[both.trait == trait].sort_values("marker_id")
        assert got["marker_id"].tolist() == want["marker_id"].tolist()
        for c in ("n", "freq", "estim", "std_err"):
            assert got[c].to_numpy() == pytest.approx(want[c].to_numpy(), rel=1e-9, abs=1e-12)


def test_traits_of_the_same_people_share_their_sums(spark, monkeypatch):
    """The sums of five traits went through the shuffle five times, at once, and filled the disk."""
    monkeypatch.setattr(association, "BLOCK", 64)
    people = spark.range(640).selectExpr("id", "(id * 37) % 101 / 101D x1", "(id * 53) % 89 / 89D + sin(id) score")
    rare = spark.range(900).selectExpr("concat('r', id) marker_id", "explode(transform(array(1, 2, 3, 4), k -> (id * 31 + k * 97) % 640)) id").distinct()
    dosages = rare.union(people.selectExpr("'c' marker_id", "id")).selectExpr("marker_id", "id", "cast(pmod(hash(marker_id, id), 3) as double) dosage")
    samples, covar = people.selectExpr("id", "id + 1 AS i"), people.select("id", "x1")
    traits = people.selectExpr("id", "'a' trait", "score").union(people.selectExpr("id", "'b.2' trait", "cos(id) + x1"))
    traits = traits.union(people.filter("id <> 5").selectExpr("id", "'c' trait", "score")).union(people.selectExpr("id", "'d' trait", "-score * x1"))
    known = traits.selectExpr("id", "trait", "if(trait = 'd' and id = 7, null, score) score")
    tiles = stored.settle(association.pack_dosages(dosages, samples), "tiles")
    mine = stored._written[spark.sparkContext.applicationId]
    for limit, most, ways in ((1e9, association.TARGETS, 3), (0.25, 1, 4)):
        monkeypatch.setattr(association, "SUMS", limit)
        monkeypatch.setattr(association, "TARGETS", most)
        start = len(mine)
        got = association.linear_traits(tiles, samples, known, covar, ["x1"], ["a", "b.2", "c", "d"])
        assert len(mine) == start + 1  # the sums; what they are made of is gone
        sums = spark.read.parquet(mine[-1])
        assert sums.filter("t = 0").count() == sums.filter("t = 0").select("marker_id").distinct().count() == 901
        assert sums.select("t").distinct().count() == ways
        written = {re.search(r"part-\d+-(.{36})", f).group(1) for f in sums.inputFiles()}
        assert (len(written) > 1) == (most == 1)  # a job for each part of the variants
        got = got.toPandas()
        for trait in ("a", "b.2", "c", "d"):
            own = known.filter(F.col("trait") == trait).select("id", "score")
            want = association.linear(dosages, own, covar, ["x1"]).toPandas().sort_values("marker_id")
            part = got[got.trait == trait].sort_values("marker_id")
            assert part["marker_id"].tolist() == want["marker_id"].tolist()
            for c in ("n", "freq", "estim", "std_err"):
                assert part[c].to_numpy() == pytest.approx(want[c].to_numpy(), rel=1e-9, abs=1e-12)


def test_repeated_people_share_only_equal_rows(spark):
    """Rows that come twice count twice; a trait with two values in a row keeps its rows to itself."""
    rows = spark.range(50).selectExpr("id", "cos(id) x1", "explode(array('a', 'b', 'c', 'd')) trait")
    rows = rows.selectExpr("trait", "id", "sin(id + ascii(trait)) score", "x1")
    rows = rows.union(rows.filter("id < 9 and trait <> 'd'")).union(rows.filter("id = 3 and trait = 'c'").selectExpr("trait", "id", "score + 1", "x1"))
    people, found = association._shared_people(rows, ["x1"], ["a", "b", "c", "d"], "trait", "score")
    assert found["a"] == (0, 0) and found["b"] == (0, 1) and len({i for i, _ in found.values()}) == 3
    for trait, (i, at) in found.items():
        want = association.People(rows.filter(F.col("trait") == trait), ["id"], "score", ["x1"]).residual()
        got = people[i].of(at)
        assert (got.n, got.rank) == (want.n, want.rank) and got.rows.count() == want.n
        assert [got.yy, got.y_total] == pytest.approx([want.yy, want.y_total], abs=1e-9)


def test_disease_scan_keeps_its_tiles_and_sums_alone(spark, folder):
    """The long dosages stayed on disk while the tiles were multiplied."""
    before = set(stored._written.get(spark.sparkContext.applicationId, ()))
    entry.queries()["gwas_diseases"](spark, folder)
    left = [path.rsplit("/", 1)[-1].rsplit("-", 1)[0] for path in stored._written[spark.sparkContext.applicationId] if path not in before]
    assert left.count("tiles") == left.count("sums") == 1 and not {"known", "people", "people-blocks", "traits"} & set(left)


def test_rows_of_an_id_meet_its_dosages_once(spark):
    """Two parents of one genotype: their sums are joined, the results are those of doubled rows."""
    people = spark.range(120).selectExpr("id", "explode(array('f', 'm')) parent").selectExpr("id", "parent", "sin(id + length(parent) + ascii(parent)) y", "cos(id) x1")
    dosages = people.selectExpr("concat('r', id % 5) marker_id", "id", "cast(id % 3 as double) dosage").distinct()
    scan = association.People(people, ["id", "parent"], "y", ["x1"])
    sums = association._long_sums(dosages, scan)
    rows = dosages.join(scan.rows, "id").groupBy("marker_id").agg(F.count("*").alias("n"), F.sum(F.col("dosage") * F.col("y")).alias("sgy"), F.sum("q1").alias("s_q1"))
    got, want = ({r["marker_id"]: r for r in t.collect()} for t in (sums, rows))
    assert {m: r["n"] for m, r in got.items()} == {m: r["n"] for m, r in want.items()}
    for m, r in want.items():
        assert [got[m]["sgy"], got[m]["s_q1"]] == pytest.approx([r["sgy"], r["s_q1"]], abs=1e-9)
    text = sums._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Aggregate [id") == 1


def test_settled_tables_leave_no_shuffle_files(spark):
    """They went only when the driver collected garbage, and filled the executors' disks."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f.getName() for f in (lambda a: [a.apply(i) for i in range(a.size())])(disk.getAllFiles()) if f.getName().startswith("shuffle")}
    before = shuffles()
    setting = spark.conf.get(stored.CLEANED, "false")
    got = stored.settle(spark.range(4000, numPartitions=8).groupBy((F.col("id") % 700).alias("k")).count(), "counts")
    deadline = time.time() + 10
    while shuffles() - before and time.time() < deadline:
        time.sleep(0.1)
    assert not shuffles() - before and spark.conf.get(stored.CLEANED, "false") == setting
    assert got.count() == 700 and got.agg(F.sum("count")).first()[0] == 4000


def _left(spark, make):
    """A table's rows, and how many written tables its plan leaves behind."""
    mine = stored._written.setdefault(spark.sparkContext.applicationId, [])
    start = len(mine)
    table = make()
    return table.collect(), len(mine) - start


def test_near_duplicates_keep_only_what_they_read(spark):
    text = "concat_ws(' ', transform(sequence(1, 60), i -> concat('w', (id div 4) * 100 + if(i = 60, id, i))))"
    docs = spark.range(200).selectExpr("id doc_id", f"{text} text")
    rows, left = _left(spark, lambda: neardup.near_duplicates(docs))
    assert left == 3 and {r["component_id"] for r in rows} == set(range(0, 200, 4))


def test_toxicity_keeps_no_model_tables(spark):
    docs = spark.range(300).selectExpr("id doc_id", "if(id % 2 = 0, 'vile awful slur', 'mild kind word') text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 = 0 as int) toxic")
    rows, left = _left(spark, lambda: toxicity.scored(docs, labels, score_col="score"))
    assert left == 0 and all((r["score"] >= 0.5) == (r["doc_id"] % 2 == 0) for r in rows)
