"""Queries over scores, phenotypes, covariates and lifelong risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.catalog import sqltext
from cohortspark.catalog.registry import query
from cohortspark.functions import numeric
from cohortspark.functions.nulls import rounded
from cohortspark.operators import ordered
from cohortspark.plans import records, scores
from cohortspark.sources.stored import reuse

DISEASES = scores.DISEASES
_LIST = ", ".join(DISEASES)

MASKED = """masked AS (SELECT s.id, s.sex, s.age, s.name, CASE WHEN o.age < s.age THEN NULL ELSE s.score END AS score
  FROM fx_score s LEFT JOIN fx_onset o ON o.id = s.id AND o.cohort = s.name)"""
POP = f"""{MASKED}, wide AS (SELECT id, sex, age, MAX(CASE WHEN name = 'longevity' THEN score END) AS longevity,
  {", ".join(f"MAX(CASE WHEN name = '{d}' THEN score END) AS {d}" for d in DISEASES)} FROM masked GROUP BY id, sex, age),
pop AS (SELECT *, CASE WHEN longevity IS NOT NULL THEN cume_dist() OVER (PARTITION BY age, sex ORDER BY longevity) END AS longevity_q FROM wide)"""


def onsets(fx):
    return records.disease_onset(fx("diagnosis"), fx("disease_dict"))


def population(fx, stored=True):
    """The score table; ``stored``, it is written once for all queries of a session on these files."""
    table = scores.score_table(fx("score"), onsets(fx))
    return reuse(table, "population") if stored else table


@query("stored_population", f"WITH {POP} SELECT age, sex, CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(longevity) AS BIGINT) AS known, round(SUM(longevity), 4) AS total FROM pop GROUP BY age, sex")
def stored_population(fx):
    """A reader of the table that other queries have stored, or that it stores for them."""
    return population(fx).groupBy("age", "sex").agg(
        F.count(F.lit(1)).alias("n"), F.count("longevity").alias("known"), F.round(F.sum("longevity"), 4).alias("total"))


@query("rolling_mean", """
SELECT id, name, age, round(CASE WHEN COUNT(*) OVER w = 2 THEN AVG(score) OVER w END, 9) AS pair FROM fx_score
WINDOW w AS (PARTITION BY id, name ORDER BY age ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)""")
def rolling_mean(fx):
    rows = ordered.rolling_mean(fx("score"), ["id", "name"], [F.col("age")], "score", "pair")
    return rows.select("id", "name", "age", rounded(F.col("pair"), 9).alias("pair"))


@query("level_code", """
SELECT id, age, name, CAST(NULLIF(coalesce(list_position(['longevity', 'cvd', 'diabetes'], name), 0), 0) AS INTEGER) AS code FROM fx_score""")
def level_code(fx):
    return fx("score").select("id", "age", "name", numeric.level_code(F.col("name"), ["longevity", "cvd", "diabetes"]).alias("code"))


@query("fold_mean", """
SELECT id, sex, age, name, round(AVG(score), 6) AS score FROM (SELECT id, sex, age, name, score * (1e0 + (f - 1) / 1e1) AS score
  FROM (SELECT *, unnest([0, 1, 2, 3, 4]) AS f FROM fx_score) x) y GROUP BY id, sex, age, name""")
def fold_mean(fx):
    folds = fx("score").select("*", F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("cv"))
    shifted = folds.withColumn("score", F.col("score") * (1 + (F.col("cv") - 1) / 10.0))
    renamed = shifted.withColumn("name", F.when(F.col("name") == "cvd", "ncvd").otherwise(F.col("name")))
    return scores.fold_mean(renamed).withColumn("score", rounded(F.col("score")))


@query("score_table", f"WITH {POP} SELECT id, sex, age, longevity, round(longevity_q, 6) AS longevity_q, {_LIST} FROM pop")
def score_table(fx):
    return population(fx, stored=False).withColumn("longevity_q", rounded(F.col("longevity_q")))


@query("longevity_q", """
SELECT id, age, sex, diabetes, round(CASE WHEN diabetes IS NOT NULL THEN cume_dist() OVER (PARTITION BY age, sex, diabetes IS NULL ORDER BY diabetes) END, 6) AS diabetes_q FROM fx_pop""")
def longevity_q(fx):
    rows = scores.longevity_q(fx("pop").select("id", "age", "sex", "diabetes"), "diabetes")
    return rows.withColumn("diabetes_q", rounded(F.col("diabetes_q")))


@query("rank_norm", f"""
SELECT id, age, sex, round({sqltext.qnorm('p')}, 6) AS z FROM (SELECT *, {sqltext.rank_norm(['age', 'sex'], 'longevity')} AS p FROM fx_pop WHERE longevity IS NOT NULL) r""")
def rank_norm(fx):
    rows = scores.rank_norm(fx("pop").select("id", "age", "sex", "longevity"), ["age", "sex"], "longevity", "z")
    return rows.select("id", "age", "sex", rounded(F.col("z")).alias("z"))


@query("closest_age", """
SELECT id, sex, age, longevity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(age - 60), age) AS rn FROM fx_pop) r WHERE rn = 1""")
def closest_age(fx):
    return scores.closest_age(fx("pop").select("id", "sex", "age", "longevity"), ["id"])


LONGEVITY = f"""lp AS (SELECT id, sex, age, longevity, {sqltext.qnorm('p')} AS score FROM (
  SELECT *, {sqltext.rank_norm(['age', 'sex'], 'longevity')} AS p FROM fx_pop WHERE age <> 80) r
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(age - 60), age) = 1)"""
DISEASE = f"""dp AS (SELECT id, sex, age, disease, score, {sqltext.qnorm('p')} AS score_norm FROM (
  SELECT *, {sqltext.rank_norm(['disease', 'age', 'sex'], 'score')} AS p FROM (
    SELECT id, sex, age, name AS disease, COALESCE(score, 1e0) AS score FROM fx_score WHERE name <> 'longevity' AND age <> 80
    QUALIFY row_number() OVER (PARTITION BY id, name ORDER BY abs(age - 60), age) = 1) f) r)"""


@query("longevity_phenotype", f"WITH {LONGEVITY} SELECT id, sex, age, longevity, round(score, 6) AS score FROM lp")
def longevity_phenotype(fx):
    return scores.longevity_phenotype(fx("pop")).withColumn("score", rounded(F.col("score")))


@query("disease_score_norm", f"WITH {DISEASE} SELECT id, sex, age, disease, score, round(score_norm, 6) AS score_norm FROM dp")
def disease_score_norm(fx):
    return scores.disease_phenotype(fx("pop")).withColumn("score_norm", rounded(F.col("score_norm")))


@query("covariates", f"""WITH {LONGEVITY}, {DISEASE} SELECT lp.id, lp.age, lp.sex,
  {", ".join(f"round(MAX(CASE WHEN dp.disease = '{d}' THEN dp.score_norm END), 6) AS {d}" for d in DISEASES)}
FROM lp LEFT JOIN dp ON lp.id = dp.id AND lp.age = dp.age GROUP BY lp.id, lp.age, lp.sex""")
def covariates(fx):
    pop = fx("pop")
    table = scores.checked_covariates(scores.longevity_phenotype(pop), scores.disease_phenotype(pop))
    return table.withColumns({d: rounded(F.col(d)) for d in DISEASES})


_CTES, _QS = sqltext.gram_schmidt("filled", ["age", "sex", *DISEASES])
_FIT = " + ".join(f"(SELECT SUM(longevity_q * {q}) / SUM({q} * {q}) FROM g7) * {q}" for q in _QS)


@query("score_residual", f"""WITH {POP}, filled AS (SELECT id, age, sex, longevity_q, {", ".join(f"COALESCE({d}, 1e0) AS {d}" for d in DISEASES)} FROM pop WHERE longevity_q IS NOT NULL),
{", ".join(_CTES)} SELECT id, age, round({_FIT}, 6) AS prediction, round(longevity_q - ({_FIT}), 6) AS residual_q FROM g7""")
def score_residual(fx):
    rows = scores.score_residual(population(fx))  # one pass for the sums, one for the residuals
    return rows.select("id", "age", rounded(F.col("prediction")).alias("prediction"), rounded(F.col("residual_q")).alias("residual_q"))


@query("lifelong_risk", """
SELECT disease, sex, age, sbin, round(death, 6) AS death, round(TRY_CAST(sbin AS DOUBLE) / 20, 6) AS qmax, round(TRY_CAST(sbin AS DOUBLE) / 20 - 0.05, 6) AS qmin
FROM fx_lifelong WHERE sbin <> 'no_cbc' AND disease <> 'longevity'""")
def lifelong_risk(fx):
    rows = scores.lifelong_risk(fx("lifelong").filter("disease <> 'longevity'"))
    return rows.withColumns({c: rounded(F.col(c)) for c in ("death", "qmax", "qmin")})


LIFELONG = """lk AS (SELECT sex, age, (CAST(sbin AS DOUBLE) - 0.5e0) / 20e0 AS x, death AS y FROM fx_lifelong WHERE disease = 'longevity' AND sbin NOT IN ('death', 'no_cbc')),
knot AS (SELECT * FROM lk UNION ALL SELECT sex, age, 0e0, MIN(y) FROM lk GROUP BY sex, age UNION ALL SELECT sex, age, 1e0, MAX(y) FROM lk GROUP BY sex, age),
seg AS (SELECT sex, age, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM knot WINDOW w AS (PARTITION BY sex, age ORDER BY x)),
risk AS (SELECT p.id, p.sex, p.age, p.longevity_q, CASE WHEN s.x1 IS NULL THEN s.y0 ELSE s.y0 + (s.y1 - s.y0) * (p.longevity_q - s.x0) / (s.x1 - s.x0) END AS risk
  FROM pop p LEFT JOIN seg s ON s.sex = p.sex AND s.age = p.age AND p.longevity_q >= s.x0 AND (p.longevity_q < s.x1 OR (s.x1 IS NULL AND p.longevity_q = s.x0)))"""


def risks(fx, pop=None):
    pop = population(fx) if pop is None else pop
    return scores.lifelong_longevity(pop, fx("lifelong").filter("disease = 'longevity'"))


@query("lifelong_longevity", f"WITH {POP}, {LIFELONG} SELECT id, sex, age, round(longevity_q, 6) AS longevity_q, round(risk, 6) AS risk FROM risk")
def lifelong_longevity(fx):
    rows = risks(fx).select("id", "sex", "age", "longevity_q", "risk")
    return rows.withColumns({"longevity_q": rounded(F.col("longevity_q")), "risk": rounded(F.col("risk"))})


@query("approx_lookup", """
SELECT s.id, s.age, s.name, CASE WHEN score <= 0.25e0 THEN round(score * 2, 6) WHEN score <= 0.75e0 THEN round(0.5 + (score - 0.25) * 0.4, 6) WHEN score <= 0.95e0 THEN round(0.7 + (score - 0.75) * 1.5, 6) END AS y FROM fx_score s""")
def approx_lookup(fx):
    from cohortspark.functions.numeric import interpolate

    knots = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (0.25, 0.5), (0.75, 0.7), (0.95, 1.0))])
    return fx("score").select("id", "age", "name", rounded(interpolate(F.col("score"), knots)).alias("y"))


@query("projection_long", f"""
SELECT id, age, CASE WHEN age IN (45, 50, 55, 70) THEN -x ELSE x END AS x, CASE WHEN age IN (55, 60, 70) THEN -y ELSE y END AS y, variable, value FROM (
  SELECT id, age, longevity AS x, 1e0 - longevity AS y, unnest([{", ".join(f"'{d}'" for d in DISEASES)}]) AS variable, unnest([{_LIST}]) AS value FROM fx_pop) p""")
def projection_long(fx):
    plane = fx("pop").select("id", "age", F.col("longevity").alias("x"), (1 - F.col("longevity")).alias("y"), *DISEASES)
    return scores.projection_long(plane, DISEASES)
