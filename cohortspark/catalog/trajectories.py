"""Queries over transitions between score bins, model training and feature importance."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from cohortspark.catalog import sqltext
from cohortspark.catalog.registry import query
from cohortspark.catalog.scores import POP, onsets, population
from cohortspark.functions.nulls import rounded
from cohortspark.operators.sampling import stratified_sample
from cohortspark.plans import models, trajectories
from cohortspark.session import scratch_dir
from cohortspark.sources.stored import settle

CENSOR = datetime.date(2006, 1, 31)
STEP = 15
AGES = (45, 50, 55, 60, 65, 70, 75, 80)
DISEASES = ("diabetes", "ckd", "copd", "cvd", "liver")
_BIN = lambda c: f"COALESCE(CAST(CASE WHEN {c} >= 0 AND {c} <= 1 THEN LEAST(CAST(floor({c} * 10 + 1e-12) AS INT), 9) + 1 END AS VARCHAR), 'no_score')"
VITAL = f"""vital AS (SELECT p.id, date_diff('day', p.dob, d.dod) / 365e0 AS death_age, date_diff('day', p.dob, COALESCE(d.dod, DATE '{CENSOR}')) / 365e0 AS last_age FROM fx_patient p JOIN fx_demog d ON d.id = p.id)"""


def _moves(score: str) -> str:
    return f"""{POP}, {VITAL}, st AS (SELECT a.id, a.sex, a.age, {_BIN(f'a.{score}')} AS sbin, CASE WHEN b.id IS NOT NULL THEN {_BIN(f'b.{score}')} END AS later, v.death_age, v.last_age
  FROM pop a JOIN vital v ON v.id = a.id LEFT JOIN pop b ON b.id = a.id AND b.age = a.age + {STEP} WHERE v.death_age IS NULL OR v.death_age > a.age)"""


MORTALITY = f"""{_moves('longevity_q')}, mv AS (SELECT sex, age, sbin, CASE WHEN death_age <= age + {STEP} THEN 'death' WHEN later IS NOT NULL THEN later WHEN last_age >= age + {STEP} THEN 'no_score' END AS next FROM st),
tr AS (SELECT sex, age, sbin, next, COUNT(*) AS n, COUNT(*) / CAST(SUM(COUNT(*)) OVER (PARTITION BY sex, age, sbin) AS DOUBLE) AS p FROM mv WHERE next IS NOT NULL GROUP BY sex, age, sbin, next)"""
ILL = f"""{_moves('diabetes')}, mv AS (SELECT s.sex, s.age, s.sbin, CASE WHEN o.age <= s.age + {STEP} AND death_age <= s.age + {STEP} THEN 'disease_death' WHEN o.age <= s.age + {STEP} THEN 'disease'
    WHEN death_age <= s.age + {STEP} THEN 'death' WHEN later IS NOT NULL THEN later WHEN last_age >= s.age + {STEP} THEN 'no_score' END AS next
  FROM st s LEFT JOIN fx_onset o ON o.id = s.id AND o.cohort = 'diabetes' WHERE o.age IS NULL OR o.age > s.age),
tr AS (SELECT sex, age, sbin, next, COUNT(*) AS n, COUNT(*) / CAST(SUM(COUNT(*)) OVER (PARTITION BY sex, age, sbin) AS DOUBLE) AS p FROM mv WHERE next IS NOT NULL GROUP BY sex, age, sbin, next)"""


def _vital(fx):
    people = fx("patient").select("id", "dob").join(fx("demog").select("id", "dod"), "id")
    return trajectories.vital_status(people, F.lit(CENSOR))


def mortality(fx):
    return trajectories.mortality_transitions(population(fx, stored=False), _vital(fx), STEP)


@query("markov_transition", f"WITH {MORTALITY} SELECT sex, age, sbin, next, CAST(n AS BIGINT) AS n, round(p, 6) AS p FROM tr")
def markov_transition(fx):
    return mortality(fx).withColumn("p", rounded(F.col("p")))


def _diabetes(fx):
    onset = onsets(fx).filter("cohort = 'diabetes'").select("id", F.col("age").alias("onset_age"))
    return trajectories.disease_transitions(population(fx, stored=False), _vital(fx), onset, STEP, "diabetes")


_STATES = [*map(str, range(1, 11)), "no_score", "death", "disease", "disease_death"]


@query("markov_disease", f"""WITH {ILL}, w AS (SELECT sex, age, sbin, {", ".join(f"COALESCE(MAX(CASE WHEN next = '{s}' THEN p END), 0) AS p_{s}" for s in _STATES)} FROM tr GROUP BY sex, age, sbin)
SELECT sex, age, sbin, {", ".join(f"round(p_{s}, 6) AS p_{s}" for s in _STATES)}, round(p_disease + p_disease_death, 6) AS total_disease FROM w""")
def markov_disease(fx):
    wide = trajectories.transition_matrix(_diabetes(fx), _STATES)
    return wide.select("sex", "age", "sbin", *[rounded(F.col(f"`{s}`")).alias(f"p_{s}") for s in _STATES],
                       rounded(F.col("total_disease")).alias("total_disease"))


def _chain(target: str, terminal: str) -> str:
    older = f"(SELECT age + {STEP} FROM (SELECT DISTINCT age FROM tr) x)"
    level = lambda k, src: f"""v{k} AS (SELECT t.sex, t.age, t.sbin, SUM(t.p * CASE WHEN t.next IN ({terminal}) THEN CAST(t.next IN ({target}) AS DOUBLE) ELSE o.risk END)
  / SUM(CASE WHEN t.next IN ({terminal}) OR o.risk IS NOT NULL THEN t.p END) AS risk FROM tr t LEFT JOIN v{src} o ON o.sex = t.sex AND o.age = t.age + {STEP} AND o.sbin = t.next
  WHERE t.age + {STEP} IN (SELECT age FROM v{src}) GROUP BY t.sex, t.age, t.sbin HAVING SUM(CASE WHEN t.next IN ({terminal}) OR o.risk IS NOT NULL THEN t.p END) > 0)"""  # noqa: E731
    return f"""v0 AS (SELECT sex, age, sbin, SUM(CASE WHEN next IN ({target}) THEN p ELSE 0 END) AS risk FROM tr WHERE age + {STEP} NOT IN (SELECT age FROM tr) GROUP BY sex, age, sbin),
{level(1, 0)}, {level(2, 1)}, allv AS (SELECT * FROM v0 UNION ALL SELECT * FROM v1 UNION ALL SELECT * FROM v2)
SELECT t.sex, t.age, t.sbin, round(v.risk, 6) AS risk FROM (SELECT DISTINCT sex, age, sbin FROM tr) t LEFT JOIN allv v ON v.sex = t.sex AND v.age = t.age AND v.sbin = t.sbin"""


@query("markov_lifelong", f"WITH {MORTALITY}, {_chain(chr(39) + 'death' + chr(39), chr(39) + 'death' + chr(39))}")
def markov_lifelong(fx):
    return trajectories.lifelong(mortality(fx), STEP).withColumn("risk", rounded(F.col("risk")))


@query("markov_disease_lifelong", f"""WITH {ILL}, {_chain("'disease', 'disease_death'", "'death', 'disease', 'disease_death'")}""")
def markov_disease_lifelong(fx):
    ill = (trajectories.DISEASE, trajectories.DISEASE_DEATH)
    risk = trajectories.lifelong(_diabetes(fx), STEP, ill, trajectories.TERMINAL["disease"])
    return risk.withColumn("risk", rounded(F.col("risk")))


# --- models ---------------------------------------------------------------------------

NFOLDS = 5
GENERATIONS = ((70, 75, 80), (55, 60, 65), (45, 50))  # ages whose older models are in the one before
_ALIVE = "v.death_age IS NULL OR v.death_age > p.age"
_DIED = f"WHEN v.death_age <= p.age + {STEP}"
_MORTALITY = f"""SELECT p.id, p.sex, p.age, CASE {_DIED} THEN 1 END AS known, CASE {_DIED} THEN 1 WHEN v.last_age >= p.age + {STEP} THEN 0 END AS last,
  {", ".join(f"p.{d}" for d in DISEASES)} FROM fx_pop p JOIN vital v ON v.id = p.id WHERE {_ALIVE}"""
_MODELS = ", ".join([VITAL, *sqltext.stitched(_MORTALITY, DISEASES, GENERATIONS, STEP, NFOLDS)])


def _features(fx):
    return fx("pop").select("id", "sex", "age", *DISEASES)


def _trained(fx):
    return models.train_mortality(_features(fx), _vital(fx), list(DISEASES), AGES, STEP, nfolds=NFOLDS, fit=models.linear)


def _stored(fx):
    """The models of all ages and folds, written and read back by their own list."""
    path = models.save_bundle(fx.spark, _trained(fx)[0], scratch_dir(fx.spark, "models"))
    return models.load_bundle(fx.spark, path)


_QUANTILE = "round(cume_dist() OVER (PARTITION BY age, sex ORDER BY score), 6) AS quantile"


@query("train_stitched", f"WITH {_MODELS} SELECT id, sex, age, fold, score, {_QUANTILE} FROM held")
def train_stitched(fx):
    return _trained(fx)[1].withColumn("quantile", rounded(F.col("quantile")))


def _others(disease: str) -> list[str]:
    return ["longevity", *[d for d in DISEASES if d != disease]]


def _falling_ill(d: str) -> str:
    sick = f"WHEN o.age <= p.age + {STEP} THEN 1 {_DIED} THEN 0"
    base = f"""SELECT p.id, p.sex, p.age, CASE {sick} END AS known, CASE {sick} WHEN v.last_age >= p.age + {STEP} THEN 0 END AS last, {", ".join(f"p.{x}" for x in _others(d))}
  FROM fx_pop p JOIN vital v ON v.id = p.id LEFT JOIN fx_onset o ON o.id = p.id AND o.cohort = '{d}' WHERE ({_ALIVE}) AND (o.age IS NULL OR o.age > p.age)"""
    return f"SELECT '{d}' AS disease, * FROM (WITH {', '.join(sqltext.stitched(base, _others(d), GENERATIONS, STEP, NFOLDS, d))} SELECT id, sex, age, fold, score, {_QUANTILE} FROM {d}held) t_{d}"


@query("train_disease", f"WITH {VITAL} {' UNION ALL '.join(_falling_ill(d) for d in DISEASES)}")
def train_disease(fx):
    found, table = settle(onsets(fx), "onsets"), None
    for d in DISEASES:
        onset = found.filter(F.col("cohort") == d).select("id", F.col("age").alias("onset_age"))
        features = fx("pop").select("id", "sex", "age", *_others(d))
        part = models.train_disease(features, _vital(fx), onset, _others(d), AGES, STEP, nfolds=NFOLDS, fit=models.linear)[1]
        part = part.select(F.lit(d).alias("disease"), "*")
        table = part if table is None else table.unionByName(part)
    return table.withColumn("quantile", rounded(F.col("quantile")))


_X = [f"p.{d}" for d in DISEASES]
_AT_AGE = "fx_pop p JOIN model m ON m.age = p.age"


@query("model_score", f"""WITH {_MODELS} SELECT p.id, p.sex, p.age, m.fold AS cv,
  round(LEAST(GREATEST(m.base + {" + ".join(f"COALESCE(m.w{j} * ({x} - m.m{j}), 0e0)" for j, x in enumerate(_X, 1))}, 0e0), 1e0), 9) AS score FROM {_AT_AGE}""")
def model_score(fx):
    return models.model_score(_stored(fx), _features(fx))


_CONTRIB = f"""WITH {_MODELS}, contrib AS ({" UNION ALL ".join(f"SELECT p.id, p.age, m.fold, '{d}' AS feature, {x} AS value, COALESCE(m.w{j} * ({x} - m.m{j}), 0e0) AS contribution FROM {_AT_AGE}" for j, (d, x) in enumerate(zip(DISEASES, _X), 1))})"""
SAMPLE = 10_000


def _contributions(fx):
    return models.contributions(_stored(fx), _features(fx))


@query("feature_contributions", f"""{_CONTRIB} SELECT id, age, fold, feature, round(value, 6) AS value, round(contribution, 6) AS contribution FROM contrib
QUALIFY row_number() OVER (PARTITION BY feature ORDER BY md5(concat_ws('|', id, age, fold, 'seed')), id, age, fold) <= {SAMPLE}""")
def feature_contributions(fx):
    table = stratified_sample(_contributions(fx), ["feature"], ["id", "age", "fold"], SAMPLE, "seed")
    return table.withColumns({c: rounded(F.col(c)) for c in ("value", "contribution")})


@query("feature_importance", f"{_CONTRIB} SELECT fold, feature, round(AVG(abs(contribution)), 6) AS mean_abs, CAST(COUNT(*) AS BIGINT) AS n FROM contrib GROUP BY fold, feature")
def feature_importance(fx):
    return models.importance(_contributions(fx), ["fold"]).withColumn("mean_abs", rounded(F.col("mean_abs")))


@query("top_features", f"{_CONTRIB} SELECT feature, round(AVG(abs(contribution)), 6) AS mean_abs, CAST(COUNT(*) AS BIGINT) AS n FROM contrib GROUP BY feature ORDER BY AVG(abs(contribution)) DESC, feature LIMIT 3")
def top_features(fx):
    return models.top_features(models.importance(_contributions(fx)), 3).withColumn("mean_abs", rounded(F.col("mean_abs")))
