"""Queries over survival, competing risks and clusters."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from cohortspark.catalog import sqltext
from cohortspark.catalog.registry import query
from cohortspark.catalog.scores import LIFELONG, POP, onsets, population, risks
from cohortspark.functions.nulls import rounded
from cohortspark.operators import survival
from cohortspark.plans import clusters, outcomes, records

SCORES = ("longevity", "diabetes", "ckd", "copd", "cvd", "liver")
DEATH_CENSOR = datetime.date(2006, 1, 31)
DISEASE_CENSOR = datetime.date(2005, 12, 31)
CURVE = ("surv", "std_err", "lower", "upper")


def tidy(df, *names):
    return df.withColumns({n: rounded(F.col(n)) for n in names})


def r6(*names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query("km_curve", f"WITH {', '.join(sqltext.km('fx_surv', ['grp']))} SELECT grp, time, at_risk, events, censored, {r6(*CURVE)} FROM km")
def km_curve(fx):
    return tidy(survival.km(fx("surv"), ["grp"]), *CURVE)


@query("km_median", f"WITH {', '.join(sqltext.km('fx_surv', ['grp']))} {sqltext.median('km', ['grp'])}")
def km_median(fx):
    return survival.median_survival(survival.km(fx("surv"), ["grp"]), ["grp"])


_LR = sqltext.pair_logrank("fx_surv", "grp", "1", "2")


@query("logrank", f"SELECT round(x, 6) AS chisq, 1e0 AS df, round(exp({sqltext.log_erfc('sqrt(x / 2)')}), 9) AS pval FROM (SELECT {_LR} AS x) t")
def logrank(fx):
    test = survival.logrank(fx("surv"), "grp", [1, 2])
    return test.select(rounded(F.col("chisq")).alias("chisq"), "df", rounded(F.col("pval"), 9).alias("pval"))


_SHARE = "(CAST(r{i} AS DOUBLE) / r)"
_K3 = f"""WITH c AS (SELECT time, {", ".join(f"SUM(CAST(id % 3 = {i} AS INT)) AS n{i}, SUM(CAST(id % 3 = {i} AND status = 1 AS INT)) AS d{i}" for i in range(3))} FROM fx_surv GROUP BY time),
k AS (SELECT *, d0 + d1 + d2 AS d, r0 + r1 + r2 AS r FROM (SELECT *, {", ".join(f"SUM(n{i}) OVER (ORDER BY time DESC) AS r{i}" for i in range(3))} FROM c) x),
s AS (SELECT {", ".join(f"SUM(d{i} - d * {_SHARE.format(i=i)}) AS u{i}" for i in (0, 1))}, {", ".join(f"SUM(CASE WHEN r > 1 THEN CAST(d AS DOUBLE) * (r - d) / (r - 1) * {_SHARE.format(i=i)} * ({int(i == j)} - {_SHARE.format(i=j)}) ELSE 0 END) AS v{i}{j}" for i, j in ((0, 0), (0, 1), (1, 1)))} FROM k WHERE d > 0)
SELECT round(x, 6) AS chisq, 2e0 AS df, round(exp(-x / 2), 9) AS pval FROM (SELECT (u0 * u0 * v11 - 2 * u0 * u1 * v01 + u1 * u1 * v00) / (v00 * v11 - v01 * v01) AS x FROM s) t"""


@query("logrank_k", _K3)
def logrank_k(fx):
    rows = fx("surv").withColumn("grp", F.col("id") % 3)
    test = survival.logrank(rows, "grp", [0, 1, 2])
    return test.select(rounded(F.col("chisq")).alias("chisq"), "df", rounded(F.col("pval"), 9).alias("pval"))


_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS group1, '{b}' AS group2, {sqltext.pair_logrank('s3', 'grp', str(a), str(b))} AS chisq" for a, b in ((0, 1), (0, 2), (1, 2)))


@query("logrank_pairwise", f"""WITH s3 AS (SELECT id % 3 AS grp, time, status FROM fx_surv), t AS ({_PAIRS}),
p AS (SELECT *, exp({sqltext.log_erfc('sqrt(chisq / 2)')}) AS pval FROM t), r AS (SELECT *, row_number() OVER (ORDER BY pval) AS i FROM p)
SELECT group1, group2, round(chisq, 6) AS chisq, round(pval, 9) AS pval, round(LEAST(MIN(pval * 3 / i) OVER (ORDER BY i DESC), 1), 9) AS padj FROM r""")
def logrank_pairwise(fx):
    rows = fx("surv").withColumn("grp", F.col("id") % 3)
    tests = survival.logrank_pairwise(rows, "grp", [0, 1, 2])
    return tests.withColumns({"chisq": rounded(F.col("chisq")), "pval": rounded(F.col("pval"), 9), "padj": rounded(F.col("padj"), 9)})


# --- follow-up ------------------------------------------------------------------------

FOLLOW = f"""{POP}, vis AS (SELECT id, dod, age_0 AS exp_age, date_0 AS exp_date FROM fx_demog UNION ALL SELECT id, dod, age_1, date_1 FROM fx_demog WHERE date_1 IS NOT NULL),
ps AS (SELECT p.id, p.sex, p.age, v.dod, AVG(v.exp_age) AS exp_age, AVG(date_diff('day', DATE '1970-01-01', v.exp_date)) AS exp_date, v.dod IS NOT NULL AS dead,
  date_diff('day', DATE '1970-01-01', COALESCE(v.dod, DATE '{DEATH_CENSOR}')) - AVG(date_diff('day', DATE '1970-01-01', v.exp_date)) AS follow_time
  FROM pop p JOIN vis v ON v.id = p.id AND p.age - v.exp_age BETWEEN 0 AND 5 GROUP BY p.id, p.sex, p.age, v.dod)"""


def follow_up(fx, pop=None):
    pop = fx("pop") if pop is None else pop
    return outcomes.patient_survival(pop, fx("demog"), F.lit(DEATH_CENSOR))


@query("patient_survival", f"WITH {FOLLOW} SELECT id, sex, age, CAST(dod AS VARCHAR) AS dod, {r6('exp_age', 'exp_date')}, dead, {r6('follow_time')} FROM ps")
def patient_survival(fx):
    rows = tidy(follow_up(fx), "exp_age", "exp_date", "follow_time")
    return rows.withColumn("dod", F.col("dod").cast("string"))


OUTCOME = f"""{FOLLOW}, dz AS (SELECT p.*, d.disease, o.age AS disease_age, o.date AS disease_date,
  ((o.date IS NOT NULL AND date_diff('day', DATE '1970-01-01', o.date) < p.exp_date) OR o.age < p.exp_age) AS sick_at_exp, o.date IS NOT NULL AS sick
  FROM ps p CROSS JOIN (VALUES ('diabetes'), ('ckd'), ('copd'), ('cvd'), ('liver')) AS d(disease) LEFT JOIN fx_onset o ON o.id = p.id AND o.cohort = d.disease),
dout AS (SELECT *, CASE WHEN NOT sick THEN date_diff('day', DATE '1970-01-01', DATE '{DISEASE_CENSOR}') - exp_date WHEN sick_at_exp THEN 0
  WHEN NOT sick_at_exp THEN date_diff('day', DATE '1970-01-01', disease_date) - exp_date END AS disease_follow_time FROM dz)"""


def disease_rows(fx, pop=None):
    return outcomes.disease_outcomes(follow_up(fx, pop), onsets(fx), F.lit(DISEASE_CENSOR))


@query("disease_outcome", f"""WITH {OUTCOME} SELECT id, sex, age, disease, {r6('disease_age')}, CAST(disease_date AS VARCHAR) AS disease_date,
  CAST(sick_at_exp AS DOUBLE) AS sick_at_exp, sick, {r6('disease_follow_time')} FROM dout""")
def disease_outcome(fx):
    rows = disease_rows(fx).select(
        "id", "sex", "age", "disease", "disease_age", F.col("disease_date").cast("string").alias("disease_date"),
        F.col("sick_at_exp").cast("int").cast("double").alias("sick_at_exp"), "sick", "disease_follow_time")
    return tidy(rows, "disease_age", "disease_follow_time")


_DECILE = lambda c: f"CASE WHEN {c} >= 0 AND {c} <= 1 THEN LEAST(CAST(floor({c} * 10 + 1e-12) AS INT), 9) + 1 END"


@query("km_10y", f"""WITH {FOLLOW}, kr AS (SELECT p.sex, {_DECILE('p.longevity_q')} AS qbin, s.follow_time AS time, CAST(s.dead AS INT) AS status
  FROM pop p LEFT JOIN ps s ON s.id = p.id AND s.age = p.age AND s.sex = p.sex WHERE p.age = 60 AND p.longevity_q IS NOT NULL),
{', '.join(sqltext.km('kr', ['sex', 'qbin']))}
SELECT sex, qbin, time, at_risk, events, censored, {r6(*CURVE)}, 60 AS age, round(1 - (qbin - 1) / 1e1, 6) AS x FROM km WHERE floor(time / 365) = 10
QUALIFY row_number() OVER (PARTITION BY sex, qbin ORDER BY time) = 1""")
def km_10y(fx):
    pop = population(fx)
    return tidy(outcomes.km_10y(pop, follow_up(fx, pop)), *CURVE, "x")


@query("cif_curve", f"WITH {', '.join(sqltext.cif('fx_surv', ['grp']))} SELECT grp, time, at_risk, d1, d2, {r6('est')}, round(var, 9) AS var FROM ci")
def cif_curve(fx):
    rows = survival.cumulative_incidence(fx("surv"), ["grp"])
    return rows.withColumns({"est": rounded(F.col("est")), "var": rounded(F.col("var"), 9)})


@query("cif_10y", f"""WITH {OUTCOME}, cr AS (SELECT l.disease, l.sex, {_DECILE('l.value')} AS qbin,
    CASE WHEN d.follow_time < d.disease_follow_time THEN d.follow_time ELSE d.disease_follow_time END AS time, CASE WHEN d.sick THEN 1 WHEN d.dead THEN 2 WHEN NOT d.sick THEN 0 END AS status
  FROM (SELECT id, sex, age, unnest(['diabetes', 'ckd', 'copd', 'cvd', 'liver']) AS disease, unnest([diabetes, ckd, copd, cvd, liver]) AS value FROM pop WHERE age = 60) l
  LEFT JOIN dout d ON d.id = l.id AND d.sex = l.sex AND d.age = l.age AND d.disease = l.disease WHERE l.value IS NOT NULL),
{', '.join(sqltext.cif('cr', ['disease', 'sex', 'qbin']))},
ten AS (SELECT disease, sex, qbin, COALESCE(arg_max(est, time) FILTER (WHERE time < 3650 AND d1 > 0), 0e0) AS est, COALESCE(arg_max(var, time) FILTER (WHERE time < 3650 AND d1 > 0), 0e0) AS var
  FROM ci GROUP BY disease, sex, qbin HAVING MAX(time) >= 3650)
SELECT disease, sex, qbin, {r6('est')}, round(sqrt(var), 6) AS std, CASE WHEN est > 0 AND est < 1 THEN round(est ^ exp(-1.959963984540054e0 * sqrt(var) / (est * ln(est))), 6) END AS lower,
  CASE WHEN est > 0 AND est < 1 THEN round(est ^ exp(1.959963984540054e0 * sqrt(var) / (est * ln(est))), 6) END AS upper FROM ten""")
def cif_10y(fx):
    pop = population(fx)
    return tidy(outcomes.cif_10y(pop, disease_rows(fx, pop)), "est", "std", "lower", "upper")


# --- clusters -------------------------------------------------------------------------

_DIST = " + ".join(f"COALESCE((p.{c} - k.{c}) ^ 2, 0)" for c in SCORES)
_PRESENT = " + ".join(f"CAST(p.{c} IS NOT NULL AS INT)" for c in SCORES)
CLUSTERS = f"""{POP}, {LIFELONG}, r50 AS (SELECT p.id, p.sex, p.age, p.longevity_q AS longevity, p.diabetes, p.ckd, p.copd, p.cvd, p.liver, r.risk
  FROM pop p JOIN risk r ON r.id = p.id AND r.age = p.age WHERE p.age = 50 AND p.longevity_q IS NOT NULL),
cl AS (SELECT p.id, p.sex, p.age, p.longevity, p.diabetes, p.ckd, p.copd, p.cvd, p.liver, p.risk, k.clust, sqrt(({_DIST}) * 6e0 / ({_PRESENT})) AS dist
  FROM r50 p CROSS JOIN fx_centers k QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY ({_DIST}), k.clust) = 1),
child AS (SELECT id, sex, CASE WHEN clust BETWEEN 10 AND 14 THEN '10-14' ELSE CAST(clust AS VARCHAR) END AS clust FROM cl WHERE clust IN (1, 3) OR clust >= 10)"""


def scored_50(fx):
    rows = risks(fx).filter((F.col("age") == 50) & F.col("longevity_q").isNotNull())
    return rows.drop("longevity").withColumnRenamed("longevity_q", "longevity")


def assigned_50(fx):
    return clusters.nearest_centroid(scored_50(fx), fx("centers"), SCORES)


@query("nearest_centroid", f"WITH {CLUSTERS} SELECT id, age, clust, {r6('dist')} FROM cl")
def nearest_centroid(fx):
    return tidy(assigned_50(fx).select("id", "age", "clust", "dist"), "dist")


@query("cluster_profile", f"""WITH {CLUSTERS} SELECT clust, CAST(COUNT(*) AS BIGINT) AS n, {", ".join(f"round(AVG({c}), 6) AS {c}" for c in SCORES)},
  round(COUNT(*) * 1e2 / SUM(COUNT(*)) OVER (), 6) AS p, concat(CASE WHEN COUNT(*) > 10000 THEN concat(CAST(CAST(round_even(COUNT(*) / 1e3, 0) AS BIGINT) AS VARCHAR), 'k') ELSE CAST(COUNT(*) AS VARCHAR) END,
  ' (', CAST(CAST(round_even(COUNT(*) * 1e2 / SUM(COUNT(*)) OVER (), 0) AS BIGINT) AS VARCHAR), '%)') AS title FROM cl GROUP BY clust""")
def cluster_profile(fx):
    return tidy(clusters.profile(assigned_50(fx), SCORES), *SCORES, "p")


@query("cluster_risk", f"""WITH {CLUSTERS} SELECT clust, CASE WHEN COUNT(risk) = COUNT(*) THEN round_even(round(AVG(1 - risk) * 100, 9), 0) END AS risk FROM cl GROUP BY clust""")
def cluster_risk(fx):
    scored = scored_50(fx)
    assigned = clusters.nearest_centroid(scored, fx("centers"), SCORES)
    return clusters.survival_chance(assigned, scored)


@query("cluster_regroup", f"WITH {CLUSTERS} SELECT clust, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(id) AS BIGINT) AS ids FROM child GROUP BY clust")
def cluster_regroup(fx):
    groups = clusters.child_groups(assigned_50(fx))
    return groups.groupBy("clust").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("cluster_child_survival", f"""WITH {FOLLOW.replace(POP + ', ', CLUSTERS + ', ')}, kr AS (SELECT c.clust, c.sex, s.follow_time / 365 AS time, CAST(s.dead AS INT) AS status
  FROM child c LEFT JOIN ps s ON s.id = c.id AND s.sex = c.sex AND s.age = 50),
{', '.join(sqltext.km('kr', ['clust', 'sex']))}
SELECT clust, sex, round(time, 6) AS time, at_risk, events, censored, {r6(*CURVE)} FROM km WHERE floor(time) = 10 QUALIFY row_number() OVER (PARTITION BY clust, sex ORDER BY time) = 1""")
def cluster_child_survival(fx):
    groups = clusters.child_groups(assigned_50(fx))
    pop = fx("pop").filter("age = 50").select("id", "sex", "age")
    rows = pop.join(groups, "id").join(follow_up(fx).drop("dod"), ["id", "sex", "age"], "left")
    rows = rows.select("clust", "sex", (F.col("follow_time") / 365).alias("time"), F.col("dead").cast("int").alias("status"))
    curve = survival.km(rows, ["clust", "sex"])
    return tidy(survival.first_in_period(curve, ["clust", "sex"], F.floor("time"), 10), "time", *CURVE)


PARENTS = f"{CLUSTERS}, kp AS (SELECT c.clust, l.time, l.status FROM child c JOIN fx_parent_long l ON l.id = c.id)"


def cluster_parents(fx):
    parents = records.parents_long(records.parents_survival(fx("raw_wide")))
    return clusters.child_groups(assigned_50(fx)).join(parents, "id")


@query("cluster_parent_survival", f"""WITH {PARENTS}, {', '.join(sqltext.km('kp', ['clust']))}, md AS ({sqltext.median('km', ['clust'])})
SELECT m.clust, m.median, m.lower, m.upper, k.surv AS surv_85, k.lower AS lower_85, k.upper AS upper_85 FROM md m
LEFT JOIN (SELECT clust, {r6(*CURVE)} FROM km WHERE time = 85) k ON k.clust = m.clust""")
def cluster_parent_survival(fx):
    curve = survival.km(cluster_parents(fx), ["clust"])
    at85 = curve.filter("time = 85").select("clust", *[rounded(F.col(c)).alias(f"{c}_85") for c in ("surv", "lower", "upper")])
    return survival.median_survival(curve, ["clust"]).join(at85, "clust", "left")


_CL = [("1", "10-14"), ("1", "15"), ("1", "3"), ("10-14", "15"), ("10-14", "3"), ("15", "3")]
_CP = " UNION ALL ".join(
    f"SELECT '{a}' AS group1, '{b}' AS group2, {sqltext.pair_logrank('kp', 'clust', repr(a), repr(b))} AS chisq" for a, b in _CL)


@query("cluster_parent_pairwise", f"""WITH {PARENTS}, t AS ({_CP}), p AS (SELECT *, exp({sqltext.log_erfc('sqrt(chisq / 2)')}) AS pval FROM t),
r AS (SELECT *, row_number() OVER (ORDER BY pval NULLS LAST) AS i, COUNT(pval) OVER () AS m FROM p)
SELECT group1, group2, round(chisq, 6) AS chisq, round(pval, 9) AS pval, CASE WHEN pval IS NOT NULL THEN round(LEAST(MIN(pval * m / i) OVER (ORDER BY i DESC), 1), 9) END AS padj FROM r""")
def cluster_parent_pairwise(fx):
    tests = survival.logrank_pairwise(cluster_parents(fx), "clust", ["1", "10-14", "15", "3"])
    return tests.withColumns({"chisq": rounded(F.col("chisq")), "pval": rounded(F.col("pval"), 9), "padj": rounded(F.col("padj"), 9)})


@query("km_at_85", f"""WITH kp AS (SELECT parent, time, status FROM fx_parent_long), {', '.join(sqltext.km('kp', ['parent']))}
SELECT parent, at_risk, events, {r6(*CURVE)} FROM km WHERE time = 85""")
def km_at_85(fx):
    curve = survival.km(records.parents_long(records.parents_survival(fx("raw_wide"))), ["parent"])
    return tidy(curve.filter("time = 85").select("parent", "at_risk", "events", *CURVE), *CURVE)


GENO = f"""gp AS (SELECT d.marker_id, CASE WHEN d.dosage < 0.5 THEN 0 WHEN d.dosage < 1.5 THEN 1 ELSE 2 END AS geno, l.time, l.status FROM fx_dosage d JOIN fx_parent_long l ON l.id = d.id WHERE d.dosage IS NOT NULL),
gc AS (SELECT marker_id, geno, COUNT(*) AS c, COUNT(*) OVER (PARTITION BY marker_id) AS k, row_number() OVER (PARTITION BY marker_id ORDER BY COUNT(*), geno) AS rn FROM gp GROUP BY marker_id, geno),
gk AS (SELECT gp.* FROM gp JOIN gc ON gc.marker_id = gp.marker_id AND gc.geno = gp.geno WHERE NOT (gc.k > 2 AND gc.rn = 1)),
{', '.join(sqltext.km('gk', ['marker_id', 'geno']))}, md AS ({sqltext.median('km', ['marker_id', 'geno'])})"""


@query("km_by_genotype", f"""WITH {GENO}, low AS (SELECT *, MIN(geno) OVER (PARTITION BY marker_id) AS g0 FROM gk),
cells AS (SELECT marker_id, time, SUM(CAST(geno = g0 AS INT)) AS n0, SUM(CAST(geno <> g0 AS INT)) AS n1, CAST(SUM(CASE WHEN geno = g0 AND status = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS d0,
  CAST(SUM(CASE WHEN geno <> g0 AND status = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS d1 FROM low GROUP BY marker_id, time),
risk AS (SELECT marker_id, d0, d1, CAST(SUM(n0) OVER w AS DOUBLE) AS r0, CAST(SUM(n1) OVER w AS DOUBLE) AS r1 FROM cells WINDOW w AS (PARTITION BY marker_id ORDER BY time DESC)),
test AS (SELECT marker_id, SUM(d0 - (d0 + d1) * r0 / (r0 + r1)) ^ 2 / NULLIF(SUM(CASE WHEN r0 + r1 > 1 THEN (d0 + d1) * (r0 / (r0 + r1)) * (r1 / (r0 + r1)) * (r0 + r1 - d0 - d1) / (r0 + r1 - 1) ELSE 0 END), 0) AS x FROM risk GROUP BY marker_id)
SELECT m.marker_id, m.geno, m.median, m.lower, m.upper, round(k.surv, 9) AS surv_at, round(k.lower, 9) AS lower_at, round(k.upper, 9) AS upper_at, round(exp({sqltext.log_erfc('sqrt(t.x / 2)')}), 6) AS pval
FROM md m LEFT JOIN km k ON k.marker_id = m.marker_id AND k.geno = m.geno AND k.time = 85 LEFT JOIN test t ON t.marker_id = m.marker_id""")
def km_by_genotype(fx):
    parents = records.parents_long(records.parents_survival(fx("raw_wide")))
    rows = survival.by_genotype(fx("dosage"), parents)
    at = {c: rounded(F.col(c), 9) for c in ("surv_at", "lower_at", "upper_at")}
    return rows.withColumns({**at, "pval": rounded(F.col("pval"))})
