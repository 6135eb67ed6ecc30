"""Queries over linear and Cox association scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.catalog import sqltext
from cohortspark.catalog.registry import query
from cohortspark.catalog.scores import DISEASE, DISEASES, LONGEVITY
from cohortspark.functions.nulls import rounded
from cohortspark.operators.sampling import row_numbers
from cohortspark.plans import association, scores
from cohortspark.sources.stored import last_written, lifetime, settle


def _scan_sql(people: str, xs: list[str]) -> str:
    """Linear scan of y on dosage and xs over a people CTE, missing dosages at the mean."""
    ctes, qs = sqltext.gram_schmidt("ppl", xs)
    last = f"g{len(xs)}"
    fit = " + ".join(f"(SELECT SUM(y * {q}) / SUM({q} * {q}) FROM {last}) * {q}" for q in qs)
    own = ", ".join(f"SUM(d.dosage * b.{q}) AS g_{q}, SUM(b.{q}) AS s_{q}" for q in qs)
    explained = " + ".join(
        f"(g_{q} + m * ((SELECT SUM({q}) FROM res) - s_{q})) ^ 2 / (SELECT SUM({q} * {q}) FROM res)" for q in qs)
    df = f"((SELECT COUNT(*) FROM res) - {len(qs) + 1})"
    return f"""{people}, {', '.join(ctes)}, res AS MATERIALIZED (SELECT *, y - ({fit}) AS r FROM {last}),
mk AS (SELECT d.marker_id, COUNT(*) AS n, AVG(d.dosage) AS m, SUM(d.dosage * d.dosage) AS gg, SUM(d.dosage * b.r) AS gr, SUM(b.r) AS sr, {own}
  FROM fx_dosage d JOIN res b ON b.id = d.id WHERE d.dosage IS NOT NULL GROUP BY d.marker_id),
ad AS (SELECT marker_id, n, m, gg + ((SELECT COUNT(*) FROM res) - n) * m * m AS full_gg, gg + ((SELECT COUNT(*) FROM res) - n) * m * m - ({explained}) AS rest,
  gr + m * ((SELECT SUM(r) FROM res) - sr) AS gy FROM mk),
es AS (SELECT marker_id, n, m / 2 AS freq, gy / rest AS estim, sqrt(((SELECT SUM(r * r) FROM res) - gy * gy / rest) / {df} / rest) AS std_err FROM ad WHERE rest > 1e-8 * GREATEST(full_gg, 1))"""


def _tidy(rows):
    cols = {c: rounded(F.col(c)) for c in ("freq", "estim", "std_err", "score")}
    return rows.withColumns(cols).select("marker_id", "n", *cols)


_OUT = "SELECT marker_id, CAST(n AS BIGINT) AS n, round(freq, 6) AS freq, round(estim, 6) AS estim, round(std_err, 6) AS std_err, round(estim / std_err, 6) AS score FROM es"


def _base(fx):
    pop = fx("pop")
    phenotype = scores.longevity_phenotype(pop)
    return pop, phenotype, fx("covar").select("id", "pc1", "pc2")


_LINEAR = f"WITH {LONGEVITY}, {_scan_sql('ppl AS (SELECT lp.id, lp.score AS y, lp.age, lp.sex, c.pc1, c.pc2 FROM lp JOIN fx_covar c ON c.id = lp.id)', ['pc1', 'pc2', 'age', 'sex'])} {_OUT}"


@query("gwas_linear", _LINEAR)
def gwas_linear(fx):
    _, phenotype, pcs = _base(fx)
    covar = pcs.join(phenotype.select("id", "age", "sex"), "id")
    return _tidy(association.linear(fx("dosage"), phenotype, covar, ["pc1", "pc2", "age", "sex"]))


@query("gwas_linear_packed", _LINEAR)
def gwas_linear_packed(fx):
    _, phenotype, pcs = _base(fx)
    covar = pcs.join(phenotype.select("id", "age", "sex"), "id")
    samples = row_numbers(fx("patient").select("id"), F.col("id").cast("double"), ["id"], name="i").select("id", "i")
    packed = association.pack_dosages(fx("dosage"), samples)
    return _tidy(association.linear_packed(packed, samples, phenotype, covar, ["pc1", "pc2", "age", "sex"]))


_WITH_DISEASE = f"""ppl AS (SELECT * FROM (SELECT lp.id, lp.score AS y, lp.age, lp.sex, c.pc1, c.pc2, {", ".join(f"MAX(CASE WHEN dp.disease = '{d}' THEN dp.score_norm END) AS {d}" for d in DISEASES)}
  FROM lp JOIN fx_covar c ON c.id = lp.id LEFT JOIN dp ON dp.id = lp.id AND dp.age = lp.age GROUP BY ALL) w WHERE {" AND ".join(f"{d} IS NOT NULL" for d in DISEASES)})"""
_NAMES = ["pc1", "pc2", "age", "sex", *DISEASES]


@query("gwas_linear_covar", f"WITH {LONGEVITY}, {DISEASE}, {_scan_sql(_WITH_DISEASE, _NAMES)} {_OUT}")
def gwas_linear_covar(fx):
    pop, phenotype, pcs = _base(fx)
    covar = pcs.join(scores.covariates(phenotype, scores.disease_phenotype(pop)), "id")
    return _tidy(association.linear(fx("dosage"), phenotype, covar, _NAMES))


@query("gwas_disease", f"""WITH {DISEASE}, {_scan_sql("ppl AS (SELECT dp.id, dp.score_norm AS y, dp.age, dp.sex, c.pc1, c.pc2 FROM dp JOIN fx_covar c ON c.id = dp.id WHERE dp.disease = 'diabetes' AND dp.id IN (SELECT id FROM fx_demog WHERE date_0 IS NOT NULL AND dod IS NULL))", ['pc1', 'pc2', 'age', 'sex'])} {_OUT}""")
def gwas_disease(fx):
    rows = scores.disease_phenotype(fx("pop")).filter("disease = 'diabetes'")
    covar = fx("covar").select("id", "pc1", "pc2").join(rows.select("id", "age", "sex"), "id")
    cohort = fx("demog").filter("date_0 IS NOT NULL AND dod IS NULL")
    phenotype = rows.select("id", F.col("score_norm").alias("score"))
    return _tidy(association.linear(fx("dosage"), phenotype, covar, ["pc1", "pc2", "age", "sex"], cohort=cohort))


_TRAITS = " UNION ALL ".join(f"""SELECT '{d}' AS trait, * FROM (WITH {_scan_sql(f"ppl AS (SELECT dp.id, dp.score_norm AS y, dp.age, dp.sex, c.pc1, c.pc2 FROM dp JOIN fx_covar c ON c.id = dp.id WHERE dp.disease = '{d}')", ['pc1', 'pc2', 'age', 'sex'])} {_OUT}) t_{d}""" for d in DISEASES)


@query("gwas_diseases", f"WITH {DISEASE} {_TRAITS}")
def gwas_diseases(fx):
    """All disease scores in one pass over the stored tiles."""
    rows = settle(scores.disease_phenotype(fx("pop")), "phenotypes")
    phenotypes = rows.select("id", F.col("disease").alias("trait"), F.col("score_norm").alias("score"))
    covar = rows.select("id", F.col("disease").alias("trait"), "age", "sex").join(fx("covar").select("id", "pc1", "pc2"), "id")
    samples = row_numbers(fx("patient").select("id"), F.col("id").cast("double"), ["id"], name="i").select("id", "i")
    with lifetime(fx.spark) as keep:  # the rows and shuffle files that tiles are made of go when they are written
        tiles = settle(association.pack_dosages(fx("dosage"), samples), "tiles")
        keep.append(last_written(fx.spark))
    found = association.linear_traits(tiles, samples, phenotypes, covar, ["pc1", "pc2", "age", "sex"], DISEASES)
    cols = {c: rounded(F.col(c)) for c in ("freq", "estim", "std_err", "score")}
    return found.withColumns(cols).select("trait", "marker_id", "n", *cols)


@query("gwas_linear_pvalue")
def gwas_linear_pvalue(fx):
    _, phenotype, pcs = _base(fx)
    rows = association.with_t_pvalue(association.linear(fx("dosage"), phenotype, pcs, ["pc1", "pc2"]))
    return rows.select("marker_id", rounded(F.col("score")).alias("score"), rounded(F.col("pval")).alias("pval"))


# --- Cox ------------------------------------------------------------------------------

def _parents(fx, parent=None):
    rows = fx("parent_long").filter("NOT (status = 1 AND time < 40)")
    rows = rows if parent is None else rows.filter(F.col("parent") == parent)
    table = rows.join(fx("covar"), "id")
    return table.withColumn("is_father", (F.col("parent") == "father").cast("double"))


def _parents_sql(condition: str, keys: str = "f.id") -> str:
    return f"""SELECT {keys}, f.time, f.status, c.sex, c.pc1, c.pc2, CASE WHEN f.parent = 'father' THEN 1e0 ELSE 0e0 END AS is_father
  FROM fx_parent_long f JOIN fx_covar c ON c.id = f.id WHERE NOT (f.status = 1 AND f.time < 40) AND {condition}"""


_COX_NAMES = ["sex", "pc1", "pc2"]


@query("cox_null", f"""WITH {", ".join(sqltext.cox_null(_parents_sql("f.parent = 'father'"), ["id"], _COX_NAMES))}
SELECT id, time, status, round(resid, 6) AS resid FROM cox""")
def cox_null(fx):
    null = association.cox_null(_parents(fx, "father"), _COX_NAMES)
    return null.residuals.select("id", "time", "status", rounded(F.col("resid")).alias("resid"))


def _cox_out(rows):
    cols = {c: rounded(F.col(c)) for c in rows.columns if c not in ("marker_id", "n", "method")}
    return rows.withColumns(cols)


@query("gwas_cox")
def gwas_cox(fx):
    null = association.cox_null(_parents(fx, "father"), ["sex", "pc1", "pc2"])
    return _cox_out(association.cox(fx("dosage"), null))


@query("gwas_cox_both")
def gwas_cox_both(fx):
    null = association.cox_null(_parents(fx), ["sex", "pc1", "pc2", "is_father"], keys=["id", "parent"])
    return _cox_out(association.cox(fx("dosage"), null, keys=["id", "parent"]))


def _score_sql(condition: str, keys: list[str], names: list[str]) -> str:
    """Score statistics against a null model with covariates, before any tail correction."""
    ctes = sqltext.cox_null(_parents_sql(condition, ", ".join(f"f.{k}" for k in keys)), keys, names)
    people = f"{', '.join(ctes)}, ppl AS MATERIALIZED (SELECT id, resid AS y, {', '.join(names)} FROM cox)"
    return f"""WITH {_scan_sql(people, names)}, zz AS (SELECT marker_id, n, LEAST(m / 2, 1 - m / 2) AS maf, gy AS stat, gy / sqrt((SELECT var_samp(y) FROM ppl) * rest) AS z FROM ad WHERE rest > 1e-8 * GREATEST(full_gg, 1))
SELECT marker_id, CAST(n AS BIGINT) AS n, round(maf, 6) AS maf, round(stat, 6) AS stat, round(z, 6) AS z, round(({sqltext.log_erfc('(abs(z) / sqrt(2e0))')}) / ln(10e0), 6) AS pval_norm FROM zz"""


@query("gwas_cox_score", _score_sql("f.parent = 'father'", ["id"], _COX_NAMES))
def gwas_cox_score(fx):
    null = association.cox_null(_parents(fx, "father"), _COX_NAMES)
    return _cox_out(association.cox(fx("dosage"), null, saddlepoint=False))


@query("gwas_cox_mother_score", _score_sql("f.parent = 'mother'", ["id"], _COX_NAMES))
def gwas_cox_mother_score(fx):
    null = association.cox_null(_parents(fx, "mother"), _COX_NAMES)
    return _cox_out(association.cox(fx("dosage"), null, saddlepoint=False))


@query("gwas_cox_both_score", _score_sql("TRUE", ["id", "parent"], [*_COX_NAMES, "is_father"]))
def gwas_cox_both_score(fx):
    null = association.cox_null(_parents(fx), [*_COX_NAMES, "is_father"], keys=["id", "parent"])
    return _cox_out(association.cox(fx("dosage"), null, keys=["id", "parent"], saddlepoint=False))


# Without covariates the null model has a closed form: ties share the hazard one after another
@query("gwas_cox_plain", f"""WITH f AS (SELECT id, time, status FROM fx_parent_long WHERE parent = 'mother' AND NOT (status = 1 AND time < 40)),
t AS (SELECT time, COUNT(*) AS n, SUM(status) AS d FROM f GROUP BY time),
r AS (SELECT time, d, SUM(n) OVER (ORDER BY time DESC) AS r FROM t),
h AS (SELECT time, COALESCE((SELECT SUM(1e0 / (r - l)) FROM (SELECT unnest(range(0, CAST(d AS BIGINT))) AS l) x), 0e0) AS jump, COALESCE((SELECT SUM((CAST(l AS DOUBLE) / d) / (r - l)) FROM (SELECT unnest(range(0, CAST(d AS BIGINT))) AS l) x), 0e0) AS tied FROM r),
c AS (SELECT time, SUM(jump) OVER (ORDER BY time) AS cum, tied FROM h),
p AS MATERIALIZED (SELECT f.id, f.status - (c.cum - f.status * c.tied) AS y FROM f JOIN c ON c.time = f.time),
mk AS (SELECT g.marker_id, COUNT(*) AS n, AVG(g.dosage) AS m, SUM(g.dosage) AS sg, SUM(g.dosage * g.dosage) AS gg, SUM(g.dosage * p.y) AS gy, SUM(p.y) AS sy FROM fx_dosage g JOIN p ON p.id = g.id WHERE g.dosage IS NOT NULL GROUP BY g.marker_id),
a AS (SELECT marker_id, n, LEAST(m / 2, 1 - m / 2) AS maf, gg + ((SELECT COUNT(*) FROM p) - n) * m * m - (SELECT COUNT(*) FROM p) * m * m AS rest, gg + ((SELECT COUNT(*) FROM p) - n) * m * m AS full_gg,
  gy + m * ((SELECT SUM(y) FROM p) - sy) - m * (SELECT SUM(y) FROM p) AS stat FROM mk),
b AS (SELECT *, stat / sqrt((SELECT var_samp(y) FROM p) * rest) AS z FROM a WHERE rest > 1e-8 * GREATEST(full_gg, 1))
SELECT marker_id, CAST(n AS BIGINT) AS n, round(maf, 6) AS maf, round(stat, 6) AS stat, round(z, 6) AS z, round(({sqltext.log_erfc('(abs(z) / sqrt(2e0))')}) / ln(10e0), 6) AS pval_norm FROM b""")
def gwas_cox_plain(fx):
    null = association.cox_null(_parents(fx, "mother"), [])
    return _cox_out(association.cox(fx("dosage"), null, saddlepoint=False))
