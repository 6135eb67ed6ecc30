"""Queries over laboratory values, feature tables and time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.catalog.registry import query
from cohortspark.functions.nulls import rounded
from cohortspark.plans import features, labs, records

AGES = (60, 65, 70, 75, 80)
TRACKS = {100: "101", 101: "102", 102: "103", 103: "104"}
COHORTS = ("diabetes", "ckd", "copd", "cvd", "liver")

FIXED = """fixed AS (SELECT l.id, l.field, l.ord, l.ln, l.sex, l.age,
  CASE l.field WHEN 102 THEN l.value * 0.5 WHEN 103 THEN l.value / 10 WHEN 104 THEN l.value + 3 WHEN 106 THEN l.value * 2.5 ELSE l.value END AS value FROM fx_lab l),
chronic AS (SELECT id, MIN(age) AS age FROM fx_onset GROUP BY id),
h AS (SELECT f.*, CASE WHEN f.age >= 35 AND f.age < 85 THEN CAST(floor((f.age - 35) / 5) AS INT) + 1 END AS age_group,
  CASE WHEN c.age IS NULL OR c.age > f.age THEN 1 ELSE 0 END AS healthy FROM fixed f LEFT JOIN chronic c ON f.id = c.id),
norm AS (SELECT *, CASE WHEN SUM(healthy) OVER (PARTITION BY field, age_group, sex) >= 10 THEN
  CAST(SUM(healthy) OVER (PARTITION BY field, age_group, sex ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
  / SUM(healthy) OVER (PARTITION BY field, age_group, sex) END AS q FROM h)"""


def fixed_labs(fx):
    return labs.unit_fix(fx("lab").select("id", "field", "ord", "ln", "sex", "age", "value"), fx("unit_rule"))


def chronic(fx):
    return records.disease_onset(fx("diagnosis"), fx("disease_dict")).groupBy("id").agg(F.min("age").alias("age"))


@query("unit_fix", f"WITH {FIXED} SELECT id, field, ord, ln, round(value, 4) AS value FROM fixed")
def unit_fix(fx):
    return fixed_labs(fx).select("id", "field", "ord", "ln", F.round("value", 4).alias("value"))


@query("normalize_labs", f"""WITH {FIXED} SELECT id, field, ord, ln, sex, CAST(age_group AS DOUBLE) AS age_group, healthy, round(value, 4) AS value, round(q, 6) AS q FROM norm""")
def normalize_labs(fx):
    rows = labs.normalize_labs(fixed_labs(fx), chronic(fx))
    return rows.select(
        "id", "field", "ord", "ln", "sex", F.col("age_group").cast("double").alias("age_group"), "healthy",
        F.round("value", 4).alias("value"), rounded(F.col("q")).alias("q"))


@query("lab_quantiles", f"""WITH {FIXED} SELECT field, CAST(age_group AS DOUBLE) AS age_group, sex, n, p, round(value, 6) AS value FROM (
  SELECT field, age_group, sex, COUNT(*) AS n, unnest([0.05e0, 0.25e0, 0.5e0, 0.75e0, 0.95e0]) AS p,
  unnest(quantile_cont(CAST(value AS DOUBLE), [0.05, 0.25, 0.5, 0.75, 0.95])) AS value FROM h WHERE healthy = 1 GROUP BY field, age_group, sex) g WHERE n >= 10""")
def lab_quantiles(fx):
    rows = labs.lab_quantiles(fixed_labs(fx), chronic(fx), [0.05, 0.25, 0.5, 0.75, 0.95])
    return rows.withColumns({"age_group": F.col("age_group").cast("double"), "value": rounded(F.col("value"))})


@query("lab_reference_q", """
SELECT l.id, l.field, l.ord, l.ln, round(COALESCE(
  MAX(CASE WHEN l.value >= a.value AND l.value < b.value THEN a.p + (b.p - a.p) * (l.value - a.value) / (b.value - a.value) END),
  CASE WHEN l.value >= MAX(b.value) THEN MAX(b.p) ELSE MIN(a.p) END), 6) AS q
FROM (SELECT row_number() OVER () AS rn, * FROM fx_lab) l JOIN fx_quantile_ref a ON a.field = l.field
JOIN fx_quantile_ref b ON b.field = a.field AND b.p = a.p + 0.25 GROUP BY l.rn, l.id, l.field, l.ord, l.ln, l.value""")
def lab_reference_q(fx):
    rows = labs.reference_quantile(fx("lab").select("id", "field", "ord", "ln", "value"), fx("quantile_ref"))
    return rows.select("id", "field", "ord", "ln", rounded(F.col("q")).alias("q"))


_AGE_LIST = ", ".join(map(str, AGES))
_LAB_COLS = ", ".join(f"round(AVG(CASE WHEN feature = '{features.lab_name(t)}' THEN v END), 9) AS {features.lab_name(t)}" for t in TRACKS.values())
_DX_COLS = ", ".join(f"MAX(CASE WHEN feature = '{features.disease_name(c)}' THEN 1e0 ELSE 0e0 END) AS {features.disease_name(c)}" for c in COHORTS)
LONG = f"""{FIXED}, ages AS (SELECT unnest([{_AGE_LIST}]) AS a),
long AS (SELECT n.id, a.a, concat('lab_', CAST(n.field + 1 AS VARCHAR)) AS feature, n.q AS v FROM norm n JOIN ages a ON n.age < a.a AND n.age > a.a - 5
    WHERE n.q IS NOT NULL AND n.field BETWEEN 100 AND 103
  UNION ALL SELECT o.id, a.a, concat('dx_', o.cohort), 1.0e0 FROM fx_onset o JOIN ages a ON o.age <= a.a WHERE o.cohort IN ('diabetes', 'ckd', 'copd', 'cvd', 'liver'))"""


def _normal(fx, fields=tuple(TRACKS)):
    """Quantiles of the labs that a feature table uses."""
    return labs.normalize_labs(fixed_labs(fx).filter(F.col("field").isin(list(fields))), chronic(fx))


@query("feature_matrix", f"""WITH {LONG} SELECT f.*, p.sex, CAST(p.sex = 1 AS INT) AS male FROM (
  SELECT id, a AS age, {_LAB_COLS}, {_DX_COLS} FROM long GROUP BY id, a) f JOIN fx_patient p ON p.id = f.id WHERE f.lab_101 IS NOT NULL""")
def feature_matrix(fx):
    onsets = records.disease_onset(fx("diagnosis"), fx("disease_dict"))
    m = features.feature_matrix(_normal(fx), onsets, fx("patient"), AGES, TRACKS, COHORTS, required="101")
    return m.withColumns({c: rounded(F.col(c), 9) for c in m.columns if c.startswith("lab_")})


BREAKS = (-3650.0, -1825.0, -1095.0, -365.0, 0.0)
_BUCKET = "CASE WHEN dt >= -3650 AND dt < -1825 THEN 'minus3650' WHEN dt >= -1825 AND dt < -1095 THEN 'minus1825' WHEN dt >= -1095 AND dt < -365 THEN 'minus1095' WHEN dt >= -365 AND dt < 0 THEN 'minus365' END"
_BCOLS = ", ".join(
    f"CASE WHEN COUNT(*) FILTER (feature = 'lab_{t}_{b}' AND v IS NULL) = 0 THEN round(AVG(CASE WHEN feature = 'lab_{t}_{b}' THEN v END), 9) END AS lab_{t}_{b}"
    for t in ("101", "102") for b in ("minus3650", "minus1825", "minus1095", "minus365"))


@query("feature_buckets", f"""WITH {FIXED}, lb AS (SELECT id, concat('lab_', CAST(field + 1 AS VARCHAR), '_', {_BUCKET}) AS feature, q AS v, {_BUCKET} AS bucket
  FROM (SELECT *, (age - 70) * 365 AS dt FROM norm WHERE age < 70 AND field IN (100, 101)) x)
SELECT l.*, 70e0 AS age, CAST(p.sex = 2 AS DOUBLE) AS female, CAST(p.sex = 1 AS DOUBLE) AS male,
  CAST(EXISTS (SELECT 1 FROM fx_onset o WHERE o.id = l.id AND o.cohort = 'diabetes' AND o.age <= 70) AS DOUBLE) AS dx_diabetes_minus43800_0,
  CAST(EXISTS (SELECT 1 FROM fx_onset o WHERE o.id = l.id AND o.cohort = 'cvd' AND o.age <= 70) AS DOUBLE) AS dx_cvd_minus43800_0
FROM (SELECT id, {_BCOLS} FROM lb WHERE bucket IS NOT NULL GROUP BY id) l JOIN fx_patient p ON p.id = l.id""")
def feature_buckets(fx):
    onsets = records.disease_onset(fx("diagnosis"), fx("disease_dict"))
    windows = {"diabetes": (-43800, 0), "cvd": (-43800, 0)}
    m = features.feature_buckets(_normal(fx, (100, 101)), onsets, fx("patient"), 70, {100: "101", 101: "102"}, BREAKS, windows)
    return m.withColumns({c: rounded(F.col(c), 9) for c in m.columns if c.startswith("lab_")})


@query("drop_sparse_features", f"""WITH {LONG}, t AS (SELECT COUNT(*) AS n FROM (SELECT DISTINCT id, a FROM long) k)
SELECT feature, CAST(COUNT(*) AS BIGINT) AS n, round(SUM(v), 4) AS total FROM long
WHERE feature IN (SELECT feature FROM (SELECT feature, COUNT(*) AS c FROM (SELECT DISTINCT feature, id, a FROM long) d GROUP BY feature) e, t WHERE 1 - c / t.n < 0.62)
GROUP BY feature""")
def drop_sparse_features(fx):
    onsets = records.disease_onset(fx("diagnosis"), fx("disease_dict"))
    long = features.model_age_values(_normal(fx), onsets, AGES, TRACKS, COHORTS)
    kept = features.drop_sparse(long, ["id", "model_age"], 0.62)
    return kept.groupBy("feature").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("bucketize", """
SELECT id, age, name, CAST(CASE WHEN score >= 0 AND score <= 1 THEN LEAST(floor(score * 10 + 1e-12), 9) + 1 END AS DOUBLE) AS closed_last,
  CASE WHEN age >= 45 AND age < 60 THEN '[45,60)' WHEN age >= 60 AND age < 80 THEN '[60,80)' END AS age_band FROM fx_score""")
def bucketize(fx):
    from cohortspark.functions.numeric import bucketize as cut, interval_label

    breaks = [i / 10 for i in range(11)]
    bands = (45, 60, 80)
    return fx("score").select(
        "id", "age", "name",
        cut(F.col("score"), breaks, include_lowest=True).cast("double").alias("closed_last"),
        interval_label(cut(F.col("age"), bands), bands).alias("age_band"))


_WINDOW = "(VALUES ('view', -72e0, 0e0), ('click', -72e0, 0e0), ('purchase', -240e0, 0e0), ('error', -240e0, 0e0)) AS w(track, lo, hi)"


@query("window_values", f"""
SELECT a.id, a.t, w.track, CAST(COUNT(e.ts) AS BIGINT) AS size, round(AVG(e.value), 6) AS avg, arg_min(e.value, (e.ts, e.value)) AS earliest,
  round(MIN(e.ts) - a.t, 6) AS dt1, round(a.t - MIN(e.ts), 6) AS dt2
FROM fx_anchor a CROSS JOIN {_WINDOW} LEFT JOIN fx_track e ON e.id = a.id AND e.track = w.track AND e.ts >= a.t + w.lo AND e.ts <= a.t + w.hi
GROUP BY a.id, a.t, w.track""")
def window_values(fx):
    windows = {"view": (-72.0, 0.0), "click": (-72.0, 0.0), "purchase": (-240.0, 0.0), "error": (-240.0, 0.0)}
    rows = features.window_values(fx("anchor"), fx("track"), windows)
    return rows.withColumns({c: rounded(F.col(c)) for c in ("avg", "dt1", "dt2")})


_AGE = "(a.t - date_diff('day', DATE '1970-01-01', p.dob) * 24e0) / 8760e0"


@query("window_features", f"""
SELECT a.id, a.t, round({_AGE}, 6) AS age, CAST(p.sex - 1 AS INTEGER) AS sex,
  round(AVG(CASE WHEN e.track = 'view' AND e.ts >= a.t - 72e0 THEN e.value END), 6) AS view, round(AVG(CASE WHEN e.track = 'click' AND e.ts >= a.t - 72e0 THEN e.value END), 6) AS click,
  MAX(CASE WHEN e.track = 'purchase' THEN 1e0 ELSE 0e0 END) AS purchase, MAX(CASE WHEN e.track = 'error' THEN 1e0 ELSE 0e0 END) AS error
FROM (SELECT DISTINCT id, t FROM fx_anchor) a LEFT JOIN fx_patient p ON p.id = a.id
LEFT JOIN fx_track e ON e.id = a.id AND e.ts >= a.t - 240e0 AND e.ts <= a.t GROUP BY a.id, a.t, p.dob, p.sex""")
def window_features(fx):
    anchors = fx("anchor").select("id", "t").distinct()
    born = F.datediff("dob", F.lit("1970-01-01").cast("date")) * 24.0
    people = anchors.join(fx("patient").select("id", "dob", "sex"), "id", "left").select("id", "t", ((F.col("t") - born) / 8760.0).alias("age"), "sex")
    m = features.window_features(
        anchors, fx("track"), ["view", "click"], (-72.0, 0.0), ["purchase", "error"], (-240.0, 0.0), 1.0, people=people)
    return m.withColumns({c: rounded(F.col(c)) for c in ("age", "view", "click")})


@query("patients_at_age", """
SELECT b.id, b.time, round((b.time - b.dob) / 8760e0, 6) AS age, CAST(p.sex AS DOUBLE) AS sex,
  round((SELECT MIN(ts) FROM fx_ehr e WHERE e.id = b.id AND e.track = 'dod' AND e.ts >= b.time) / 8760e0 - b.time / 8760e0, 6) AS survival,
  round((SELECT MIN(ts) FROM fx_ehr e WHERE e.id = b.id AND e.track = 'lfg' AND e.ts >= b.time) / 8760e0 - b.time / 8760e0, 6) AS left_for_good,
  round(COALESCE((SELECT MIN(ts) FROM fx_ehr e WHERE e.id = b.id AND e.track = 'lfg' AND e.ts >= b.time) / 8760e0, 475000e0 / 8760e0) - b.time / 8760e0, 6) AS time_in_system
FROM (SELECT id, ts AS dob, ts + 240e0 AS time FROM fx_ehr WHERE track = 'dob') b LEFT JOIN fx_patient p ON p.id = b.id
WHERE b.time BETWEEN 473352e0 AND 474200e0
  AND NOT EXISTS (SELECT 1 FROM fx_ehr e WHERE e.id = b.id AND e.track IN ('dod', 'lfg') AND e.ts <= b.time)
  AND EXISTS (SELECT 1 FROM fx_ehr e WHERE e.id = b.id AND e.track = 'register' AND e.ts <= b.time)
  AND NOT EXISTS (SELECT 1 FROM fx_ehr e WHERE e.id = b.id AND e.track = 'absent' AND e.ts BETWEEN b.time - 6e0 AND b.time)""")
def patients_at_age(fx):
    rows = features.patients_at_age(fx("ehr"), fx("patient"), 240.0, 473352.0, 474200.0, 475000.0, month=6.0)
    return rows.withColumns({
        **{c: rounded(F.col(c)) for c in ("age", "survival", "left_for_good", "time_in_system")},
        "sex": F.col("sex").cast("double")})
