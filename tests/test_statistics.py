"""Estimates against closed forms, numpy and brute force on small data."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.functions import linear, numeric
from cohortspark.operators import survival
from cohortspark.plans import association, models, trajectories


def test_qnorm(spark):
    ps = [1e-300, 1e-12, 0.001, 0.02425, 0.3, 0.5, 0.7, 0.975, 0.999999]
    df = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0]], "p double")
    got = [r[0] for r in df.select(numeric.qnorm(F.col("p"))).collect()]
    assert got[-2:] == [None, None]
    for p, z in zip(ps[1:], got[1:]):
        assert z == pytest.approx(NormalDist().inv_cdf(p), rel=1e-12, abs=1e-13)
    assert got[0] == pytest.approx(-37.0471, abs=1e-3)


def test_normal_tail(spark):
    zs = [0.0, 0.1, 0.6, 1.0, 3.0, 5.0, 8.0, 20.0, 37.0]
    df = spark.createDataFrame([(z,) for z in [*zs, -3.0, 60.0]], "z double")
    got = [r[0] for r in df.select(numeric.log10_normal_two_sided(F.col("z"))).collect()]
    for z, v in zip(zs, got):
        assert v == pytest.approx(math.log10(math.erfc(z / math.sqrt(2))), rel=1e-12, abs=1e-13)
    assert got[-2] == got[4]
    x = 60.0  # asymptotic series
    assert got[-1] == pytest.approx((-x * x / 2 - math.log(x * math.sqrt(math.pi / 2)) + math.log(1 - 1 / x**2 + 3 / x**4)) / math.log(10), rel=1e-9)


def test_t_and_chisq_tails():
    # df = 1 is Cauchy, df = 2 has a closed form
    t = np.array([0.0, 0.5, 3.0, 40.0])
    one = 10 ** numeric.log10_t_tail(t, np.ones(4))
    assert one == pytest.approx(1 - 2 / math.pi * np.arctan(t))
    two = 10 ** numeric.log10_t_tail(t, np.full(4, 2.0))
    assert two == pytest.approx(1 - t / np.sqrt(2 + t**2), abs=1e-12)
    # many degrees of freedom: the normal tail
    big = numeric.log10_t_tail(np.array([6.0]), np.array([1e7]))[0]
    assert big == pytest.approx(math.log10(math.erfc(6 / math.sqrt(2))), rel=1e-5)
    x = np.array([0.01, 1.0, 7.0, 90.0])
    assert numeric.chisq_tail(x, np.full(4, 2.0)) == pytest.approx(np.exp(-x / 2))
    assert numeric.chisq_tail(x, np.ones(4)) == pytest.approx([math.erfc(math.sqrt(v / 2)) for v in x])
    assert numeric.chisq_tail(x, np.full(4, 4.0)) == pytest.approx(np.exp(-x / 2) * (1 + x / 2))


def test_kaplan_meier_by_hand(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 0), ("a", 3.0, 1), ("a", 3.0, 1), ("a", 4.0, 0), ("b", 2.0, 1)], "g string, time double, status int")
    curve = {(r["g"], r["time"]): r for r in survival.km(df, ["g"]).collect()}
    assert curve["a", 1.0]["surv"] == pytest.approx(0.8)
    assert curve["a", 2.0]["surv"] == pytest.approx(0.8) and curve["a", 2.0]["censored"] == 1
    assert curve["a", 3.0]["surv"] == pytest.approx(0.8 / 3)
    assert curve["a", 3.0]["std_err"] == pytest.approx(math.sqrt(1 / 20 + 2 / 3))
    assert curve["b", 2.0]["surv"] == 0.0 and curve["b", 2.0]["lower"] is None
    med = {r["g"]: r["median"] for r in survival.median_survival(survival.km(df, ["g"]), ["g"]).collect()}
    assert med == {"a": 3.0, "b": 2.0}


def test_median_between_steps(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (5.0, 1), (9.0, 1)], "time double, status int")
    assert survival.median_survival(survival.km(df, []), []).first()["median"] == 3.5


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(3)
    n = 600
    x1, x2 = rng.normal(size=n), rng.integers(0, 2, n).astype(float)
    t = np.ceil(rng.exponential(20 * np.exp(-0.5 * x1 + 0.3 * x2)))
    status = (rng.random(n) < 0.7).astype(int)
    rows = [(i, float(t[i]), int(status[i]), float(x1[i]), float(x2[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, time double, status int, x1 double, x2 double").repartition(3).cache()


@pytest.mark.parametrize("slices", [1, 6])
def test_curves_do_not_depend_on_slices(people, slices):
    df = people.withColumn("status", F.when(F.col("id") % 5 == 0, 2).otherwise(F.col("status")))
    key = lambda f: sorted((tuple(r) for r in f.collect()))
    for fn in (survival.km, survival.cumulative_incidence):
        a, b = key(fn(df, ["x2"], slices=1).fillna(-1.0)), key(fn(df, ["x2"], slices=slices).fillna(-1.0))
        assert len(a) == len(b) and all(x == pytest.approx(y, rel=1e-9, abs=1e-12) for x, y in zip(a, b))


def test_incidence_and_survival_add_to_one(people):
    df = people.withColumn("status", F.when(F.col("id") % 5 == 0, 2).otherwise(F.col("status")))
    swap = df.withColumn("status", F.when(F.col("status") == 1, 2).when(F.col("status") == 2, 1).otherwise(0))
    any_event = df.withColumn("status", (F.col("status") > 0).cast("int"))
    c1 = survival.cumulative_incidence(df, []).select("time", F.col("est").alias("a"))
    c2 = survival.cumulative_incidence(swap, []).select("time", F.col("est").alias("b"))
    s = survival.km(any_event, []).select("time", "surv")
    for r in c1.join(c2, "time").join(s, "time").collect():
        assert r["a"] + r["b"] + r["surv"] == pytest.approx(1)


def test_logrank_against_brute_force(people):
    pdf = people.toPandas().assign(g=lambda d: d.id % 4)
    u, v = np.zeros(4), np.zeros((4, 4))
    for t in sorted(pdf[pdf.status == 1].time.unique()):
        r = np.array([((pdf.g == g) & (pdf.time >= t)).sum() for g in range(4)], float)
        d = np.array([((pdf.g == g) & (pdf.time == t) & (pdf.status == 1)).sum() for g in range(4)], float)
        n, k = r.sum(), d.sum()
        u += d - k * r / n
        if n > 1:
            p = r / n
            v += k * (n - k) / (n - 1) * (np.diag(p) - np.outer(p, p))
    want = u[:3] @ np.linalg.solve(v[:3, :3], u[:3])
    got = survival.logrank(people.withColumn("g", F.col("id") % 4), "g", [0, 1, 2, 3], slices=5).first()
    assert got["chisq"] == pytest.approx(want) and got["df"] == 3


def test_pvalue_adjustment(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.04,), (None,)], "pval double")
    got = {(r["pval"], r["padj"]) for r in survival.adjust_pvalues(df).collect()}
    assert got == {(0.01, 0.04), (0.04, 0.04), (0.03, 0.04), (None, None)}


def test_ols_against_numpy(spark, people):
    pdf = people.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf.x1, pdf.x2])
    want = np.linalg.lstsq(x, pdf.time, rcond=None)[0]
    got = linear.ols_coefficients(people, [F.lit(1.0), F.col("x1"), F.col("x2")], F.col("time"))
    assert got == pytest.approx(want)
    same = linear.orthonormal(people, [F.lit(1.0), F.col("x2"), F.lit(1.0) - F.col("x2")])
    assert len(same) == 2  # the third column is implied


@pytest.fixture(scope="module")
def dosages(spark, people):
    rng = np.random.default_rng(5)
    rows = []
    for m in range(6):
        g = rng.binomial(2, 0.05 + 0.08 * m, 600).astype(float)
        for i in range(600):
            if rng.random() < 0.9:  # some people have no row, some a null
                rows.append((f"rs{m}", i, None if rng.random() < 0.03 else float(g[i])))
    rows += [("flat", i, 1.0) for i in range(600)]
    return spark.createDataFrame(rows, "marker_id string, id long, dosage double").cache()


def filled(dosages, n):
    pdf = dosages.toPandas().dropna()
    out = {}
    for m, part in pdf.groupby("marker_id"):
        g = np.full(n, part.dosage.mean())
        g[part.id.to_numpy()] = part.dosage.to_numpy()
        out[m] = g
    return out


def test_linear_scan_against_numpy(people, dosages):
    pdf = people.toPandas().sort_values("id")
    pheno = people.select("id", F.col("time").alias("score"))
    scan = association.with_t_pvalue(association.linear(dosages, pheno, people.select("id", "x1", "x2"), ["x1", "x2"])).toPandas()
    got = scan.set_index("marker_id")
    assert "flat" not in got.index
    for m, g in filled(dosages, 600).items():
        if m == "flat":
            continue
        x = np.column_stack([g, np.ones(600), pdf.x1, pdf.x2])
        beta, rss, *_ = np.linalg.lstsq(x, pdf.time, rcond=None)
        se = math.sqrt(rss[0] / (600 - 4) * np.linalg.inv(x.T @ x)[0, 0])
        assert got.loc[m, "estim"] == pytest.approx(beta[0]) and got.loc[m, "std_err"] == pytest.approx(se)
        assert 10 ** got.loc[m, "pval"] == pytest.approx(10 ** numeric.log10_t_tail(np.array([beta[0] / se]), np.array([596.0]))[0])


def efron(time, status, x, beta):
    """Gradient, Hessian and martingale residuals by direct loops."""
    e = np.exp(x @ beta)
    k = x.shape[1]
    grad, hess, hazard = np.zeros(k), np.zeros((k, k)), {}
    for t in np.unique(time):
        risk, dead = time >= t, (time == t) & (status == 1)
        d = dead.sum()
        a = b = 0.0
        grad += x[dead].sum(axis=0)
        for l in range(d):
            w = l / d
            s0 = e[risk].sum() - w * e[dead].sum()
            s1 = (e[risk, None] * x[risk]).sum(axis=0) - w * (e[dead, None] * x[dead]).sum(axis=0)
            s2 = (x[risk].T * e[risk]) @ x[risk] - w * (x[dead].T * e[dead]) @ x[dead]
            grad -= s1 / s0
            hess += s2 / s0 - np.outer(s1, s1) / s0**2
            a += 1 / s0
            b += w / s0
        hazard[t] = (a, b)
    total, resid = 0.0, np.zeros(len(time))
    for t in np.unique(time):
        a, b = hazard[t]
        total += a
        at = time == t
        resid[at] = status[at] - e[at] * (total - status[at] * b)
    return grad, hess, resid


@pytest.fixture(scope="module")
def null(people):
    return association.cox_null(people, ["x1", "x2"], slices=3)


@pytest.mark.parametrize("chunk", [1000, 2])
def test_cox_null_against_loops(people, chunk, monkeypatch):
    monkeypatch.setattr(association, "EFRON_CHUNK", chunk)
    pdf = people.toPandas().sort_values("id")
    time, status = pdf.time.to_numpy(), pdf.status.to_numpy()
    x = pdf[["x1", "x2"]].to_numpy()
    beta = np.zeros(2)
    for _ in range(20):
        g, h, _ = efron(time, status, x, beta)
        beta = beta + np.linalg.solve(h, g)
    model = association.cox_null(people, ["x1", "x2"])
    assert model.beta == pytest.approx(beta, abs=1e-8)
    resid = model.residuals.toPandas().sort_values("id").resid.to_numpy()
    # the covariates are centred inside, which rescales the baseline and leaves residuals alone
    assert resid == pytest.approx(efron(time, status, x, beta)[2], abs=1e-8)
    assert resid.sum() == pytest.approx(0, abs=1e-6)


def test_cox_scan_against_numpy(people, dosages, null):
    pdf = null.residuals.toPandas().sort_values("id")
    r = pdf.resid.to_numpy()
    x = np.column_stack([np.ones(600), pdf.x1, pdf.x2])
    got = association.cox(dosages, null).toPandas().set_index("marker_id")
    for m, g in filled(dosages, 600).items():
        if m == "flat":
            continue
        adj = g - x @ np.linalg.lstsq(x, g, rcond=None)[0]
        stat = adj @ r
        z = stat / math.sqrt(r.var(ddof=1) * (adj @ adj))
        assert got.loc[m, "stat"] == pytest.approx(stat) and got.loc[m, "z"] == pytest.approx(z)
        if abs(z) <= 2:
            assert got.loc[m, "pval"] == got.loc[m, "pval_norm"]


def test_saddlepoint_against_simulation(spark):
    """A rare allele and skewed residuals, where the normal tail is far off."""
    rng = np.random.default_rng(11)
    y = 1 - rng.exponential(1.0, 4000)
    y -= y.mean()
    table = spark.createDataFrame([(float(v),) for v in y], "y double")
    cgf = association.residual_cgf(table)
    carriers = 12
    draws = rng.choice(y, size=(400_000, carriers)).sum(axis=1)
    s = 11.0
    empirical = (np.abs(draws) >= s).mean()
    p = association.saddlepoint_tail(s, np.array([1.0]), np.array([0.0]), np.array([float(carriers)]), 0.0, cgf)
    normal = math.erfc(s / math.sqrt(2 * carriers * y.var()))
    assert 10**p == pytest.approx(empirical, rel=0.15)
    assert abs(10**p - empirical) < abs(normal - empirical)


def test_normal_residuals_give_the_normal_tail(spark):
    y = np.array([NormalDist().inv_cdf((i + 0.5) / 20001) for i in range(20001)])
    cgf = association.residual_cgf(spark.createDataFrame([(float(v),) for v in y], "y double"))
    p = association.saddlepoint_tail(30.0, np.array([1.0]), np.array([0.0]), np.array([50.0]), 50.0, cgf)
    assert p == pytest.approx(math.log10(math.erfc(3.0 / math.sqrt(2))), abs=0.01)


def test_two_rows_per_genotype(people, dosages):
    both = people.withColumn("parent", F.lit("a")).unionByName(people.withColumn("parent", F.lit("b")).withColumn("time", F.col("time") + 1))
    model = association.cox_null(both, ["x1"], keys=["id", "parent"])
    got = association.cox(dosages, model, keys=["id", "parent"], saddlepoint=False).toPandas().set_index("marker_id")
    pdf = model.residuals.toPandas()
    g = filled(dosages, 600)["rs4"][pdf.id.to_numpy()]
    x = np.column_stack([np.ones(1200), pdf.x1])
    adj = g - x @ np.linalg.lstsq(x, g, rcond=None)[0]
    assert got.loc["rs4", "stat"] == pytest.approx(adj @ pdf.resid.to_numpy())


def test_transitions_sum_to_one_and_chain(spark):
    pop = spark.createDataFrame(
        [(1, 1, 60, 0.05), (1, 1, 65, 0.95), (2, 1, 60, 0.05), (3, 1, 60, 0.05), (4, 1, 60, 0.05), (4, 1, 65, None), (5, 1, 65, 0.95), (6, 1, 65, 0.95)],
        "id int, sex int, age int, longevity_q double")
    vital = spark.createDataFrame([(1, None, 75.0), (2, 62.0, 62.0), (3, None, 62.0), (4, None, 80.0), (5, 69.0, 69.0), (6, None, 71.0)],
                                  "id int, death_age double, last_age double")
    tr = trajectories.mortality_transitions(pop, vital, 5)
    got = {(r["age"], r["sbin"], r["next"]): r["p"] for r in tr.collect()}
    # patient 3 is not followed for five years and does not count
    assert got[60, "1", "death"] == got[60, "1", "10"] == got[60, "1", "no_score"] == pytest.approx(1 / 3)
    assert got[65, "10", "death"] == pytest.approx(1 / 3) and got[65, "10", "no_score"] == pytest.approx(2 / 3)
    risk = {(r["age"], r["sbin"]): r["risk"] for r in trajectories.lifelong(tr, 5).collect()}
    assert risk[65, "10"] == pytest.approx(1 / 3)
    assert risk[60, "1"] == pytest.approx((1 + 1 / 3 + 0) / 3)


def test_stitched_training(spark):
    rng = np.random.default_rng(7)
    rows, vital = [], []
    for i in range(400):
        x = float(rng.normal())
        death = 66.0 + float(rng.random() * 4) if rng.random() < 1 / (1 + math.exp(-2 * x)) else None
        rows += [(i, 1 + i % 2, 60, x, None if i % 9 == 0 else 1.0), (i, 1 + i % 2, 65, x, 0.5)]
        vital.append((i, death, death or 90.0))
    f = spark.createDataFrame(rows, "id long, sex int, age int, a double, b double")
    v = spark.createDataFrame(vital, "id long, death_age double, last_age double")
    bundle, table = models.train_mortality(f, v, ["a", "b"], [60, 65], 5, nfolds=2)
    pdf = table.join(f, ["id", "sex", "age"]).toPandas()
    assert len(bundle) == 4 and len(pdf) == 800
    # nobody dies before 65: the younger score can only come from the older model
    for age in (60, 65):
        part = pdf[pdf.age == age]
        assert np.corrcoef(part.score, part.a)[0, 1] > 0.8
        assert part["quantile"].max() == 1.0
    c = models.contributions({(65, 0): bundle[65, 0]}, f.filter("age = 65")).toPandas()
    size = c.assign(m=c.contribution.abs()).groupby("feature").m.mean()
    assert size["a"] > 10 * size["b"]


@pytest.fixture(scope="module")
def training(spark):
    """Rows of two ages with missing values, unequal folds and one fold that is empty at one age."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(900):
        age, x = 60 + 5 * (i % 2), rng.normal(size=3) * [1, 5, 0.1] + [0, 100, 3]
        x = [None if rng.random() < 0.2 else float(v) for v in x]
        fold = int(rng.integers(0, 3 if age == 60 else 2))
        rows.append((age, fold, x, float(rng.random() < (0.3 if x[0] is None else 1 / (1 + math.exp(-x[0]))))))
    return rows, spark.createDataFrame(rows, "age int, fold int, x array<double>, y double").repartition(5)


def design(rows, age, fold, means=None):
    part = [r for r in rows if r[0] == age and r[1] != fold]
    x = np.array([[np.nan if v is None else v for v in r[2]] for r in part])
    means = np.nanmean(x, axis=0)
    return np.column_stack([np.ones(len(x)), np.nan_to_num(x - means)]), np.array([r[3] for r in part]), means


def test_out_of_fold_least_squares(training):
    rows, df = training
    bundle = models.linear(df, ["a", "b", "c"], 3)
    assert sorted(bundle) == [(a, f) for a in (60, 65) for f in range(3)]
    for (age, fold), m in bundle.items():
        z, y, means = design(rows, age, fold)
        want = np.linalg.solve(z.T @ z + 1e-3 * np.diag(np.r_[0, (z[:, 1:] ** 2).sum(axis=0) + 1e-9 * len(z)]), z.T @ y)
        assert m.means == pytest.approx(means) and [m.base, *m.weights] == pytest.approx(want, rel=1e-8)


def test_out_of_fold_logistic(training):
    """The penalised gradient is zero at the fitted weights."""
    rows, df = training
    for (age, fold), m in models.logistic(df, ["a", "b", "c"], 3).items():
        z, y, means = design(rows, age, fold)
        q = 1 / (1 + np.exp(-z @ np.r_[m.base, m.weights]))
        ridge = 1e-3 * np.r_[0, (z[:, 1:] ** 2).sum(axis=0) + 1e-9 * len(z)]
        assert np.abs(z.T @ (y - q) - ridge * np.r_[m.base, m.weights]).max() < 1e-6


def test_stored_models(spark, training, tmp_path):
    """A bundle read back needs no list; contributions add up to the score."""
    _, df = training
    bundle = models.logistic(df, ["a", "b", "c"], 3)
    bundle[70, 0] = models.Model(70, 0, "linear", ["c", "a"], [1.0, 2.0], [0.5, -0.25], 0.4)  # other features, other kind
    loaded = models.load_bundle(spark, models.save_bundle(spark, bundle, str(tmp_path / "m")))
    assert loaded == bundle
    rows = df.selectExpr("monotonically_increasing_id() id", "1 sex", "explode(array(age, 70)) age", "x[0] a", "x[1] b", "x[2] c")
    scores = models.model_score(loaded, rows).toPandas().set_index(["id", "age", "cv"]).score
    parts = models.contributions(loaded, rows).toPandas()
    total = parts.groupby(["id", "age", "fold"]).contribution.sum()
    for (i, age, fold), s in list(scores.items())[::37]:
        v = bundle[age, fold].base + total[i, age, fold]
        assert s == pytest.approx(1 / (1 + math.exp(-v)) if age < 70 else min(max(v, 0), 1), abs=1e-8)
    assert len(parts) == 900 * (3 * 3 + 2)


@pytest.mark.parametrize("markers", [2, 128])
def test_tiled_scan_is_the_same(people, dosages, markers, monkeypatch):
    """Several blocks of samples and chunks of variants, one or more phenotypes with people of their own."""
    monkeypatch.setattr(association, "BLOCK", 128)
    monkeypatch.setattr(association, "MARKERS", markers)
    pheno, covar = people.select("id", F.col("time").alias("score")), people.select("id", "x1", "x2")
    samples = people.select("id", (F.col("id") + 1).alias("i"))
    tiles = association.pack_dosages(dosages, samples).cache()
    assert {r[0] for r in tiles.selectExpr("length(dosages) / size(markers)").collect()} == {4 * 128}
    other = people.filter("id % 7 <> 0").select("id", (F.col("x1") + F.col("time") / 50).alias("score"))
    traits = pheno.withColumn("trait", F.lit("a")).union(other.withColumn("trait", F.lit("b")))
    both = association.linear_traits(tiles, samples, traits, covar, ["x1", "x2"], ["a", "b"]).toPandas()
    for trait, own in (("a", pheno), ("b", other)):
        want = association.linear(dosages, own, covar, ["x1", "x2"]).toPandas().sort_values("marker_id")
        one = association.linear_packed(tiles, samples, own, covar, ["x1", "x2"]).toPandas().sort_values("marker_id")
        for got in (one, both[both.trait == trait].sort_values("marker_id")):
            assert got["marker_id"].tolist() == want["marker_id"].tolist()
            for c in ("n", "freq", "estim", "std_err", "score"):
                assert got[c].to_numpy() == pytest.approx(want[c].to_numpy(), rel=1e-9, abs=1e-12)


def test_tiles_are_read_once(people, dosages):
    """One scan of the dosages, however many phenotypes."""
    samples = people.select("id", (F.col("id") + 1).alias("i"))
    scans = people.select("id", "x1", F.col("time").alias("y"))
    parts = [association.People(scans, ["id"], "y", ["x1"]).residual() for _ in range(3)]
    tiles = association.pack_dosages(dosages, samples)
    plan = association._tile_sums(tiles, samples, parts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # one builds the tiles, one multiplies them


def test_dependent_covariates_are_reported(people):
    table = people.select("id", F.col("time").alias("y"), (F.col("x1") + 1e7).alias("far"), F.col("x2"), (2 * F.col("x2") + 3).alias("twice"))
    with pytest.warns(UserWarning, match="1 of 3"):
        assert association.People(table, ["id"], "y", ["far", "x2", "twice"]).rank == 3
    assert association.People(table, ["id"], "y", ["far", "x2"]).rank == 3


def test_rare_variant_tail_against_simulation():
    """Few carriers and skewed residuals: the saddlepoint p-value is that of the permuted statistic."""
    rng = np.random.default_rng(11)
    y = 1 - rng.exponential(size=20_000)
    y -= y.mean()
    table = association.ResidualCgf(np.ones(len(y)), y)
    g = np.concatenate([np.full(30, 1.0), np.full(4, 2.0), np.full(25, 0.25)])  # also weak carriers
    sums = np.zeros(400_000)
    for lo in range(0, len(sums), 20_000):
        sums[lo : lo + 20_000] = rng.choice(y, (20_000, len(g))) @ g
    for s in (10.0, 15.0, 20.0):
        want = np.mean(np.abs(sums) >= s)
        got = 10 ** association.saddlepoint_tail(s, np.array([1.0, 2.0, 0.25]), np.zeros(3), np.array([30.0, 4.0, 25.0]), 0.0, table)
        assert got == pytest.approx(want, rel=0.15), s
    far = association.saddlepoint_tail(400.0, np.array([1.0]), np.zeros(1), np.array([3.0]), 5.0, table)
    assert math.isfinite(far) and far < -10  # beyond every grid: the straight ends
    assert math.isnan(association.saddlepoint_tail(400.0, np.array([1.0]), np.zeros(1), np.array([3.0]), 0.0, table))
