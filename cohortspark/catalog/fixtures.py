"""Cohort-shaped views derived from the given tables, one SQL text for Spark and DuckDB.

A few words differ between the dialects and are written as macros: ``@each(a, b, c)`` gives
one row per listed value, ``@micros(ts)`` gives microseconds since 1970 of a timestamp
without zone. ``@days(end, start)`` and ``@dmy(date)`` give a day count and day/month/year
text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SOURCES = ("customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS: dict[str, str] = {
    "patient": """
SELECT c_custkey AS id,
  CAST(1 + c_custkey % 2 AS INT) AS sex,
  make_date(CAST(1920 + (c_custkey * 7) % 31 AS INT), CAST(1 + (c_custkey * 5) % 12 AS INT), 1) AS dob,
  make_date(CAST(1994 + c_custkey % 3 AS INT), CAST(1 + (c_custkey * 11) % 12 AS INT), CAST(1 + c_custkey % 28 AS INT)) AS date_0,
  CASE WHEN c_custkey % 3 = 0 THEN make_date(CAST(1997 + c_custkey % 2 AS INT), CAST(1 + (c_custkey * 3) % 12 AS INT), CAST(1 + c_custkey % 27 AS INT)) END AS date_1,
  CASE WHEN c_custkey % 4 = 1 THEN make_date(CAST(1999 + (c_custkey * 13) % 6 AS INT), CAST(1 + (c_custkey * 7) % 12 AS INT), CAST(1 + (c_custkey * 3) % 28 AS INT)) END AS dod_a,
  CASE WHEN c_custkey % 8 IN (1, 2) THEN make_date(CAST(2000 + (c_custkey * 17) % 5 AS INT), CAST(1 + (c_custkey * 5) % 12 AS INT), CAST(1 + (c_custkey * 9) % 28 AS INT)) END AS dod_b
FROM customer""",
    # demographics as the wide-table operator returns them
    "demog": """
SELECT id, sex, dob, date_0, date_1,
  CAST(@days(date_0, dob) AS DOUBLE) / 365E0 AS age_0,
  CAST(@days(date_1, dob) AS DOUBLE) / 365E0 AS age_1,
  LEAST(dod_a, dod_b) AS dod
FROM fx_patient""",
    "icd_pick": """
SELECT * FROM (VALUES (0,'E119',10),(1,'E112',10),(2,'250',9),(3,'2501',9),(4,'I214',10),(5,'I251',10),
  (6,'410',9),(7,'J449',10),(8,'N189',10),(9,'K769',10),(10,'Z000',10),(11,'J47',10),(12,'4280',9)) AS t(k, icd, icd_version)""",
    "disease_dict": """
SELECT * FROM (VALUES ('E11',1,'diabetes',10),('250',1,'diabetes',9),('E112',0,'disease.CKD',10),('N189',0,'ckd',10),
  ('I21',1,'cvd',10),('I25',1,'cvd',10),('410',1,'cvd',9),('J449',0,'copd',10),('J47',1,'copd',10),('K769',0,'liver',10),
  ('42',1,'disease.AIDS',9),('I25',1,'disease.CARDIO',10)) AS t(icd, subs, cohort, icd_version)""",
    "diagnosis": """
SELECT o.o_custkey AS id, p.icd, p.icd_version, CAST(o.o_orderdate AS DATE) AS date,
  CAST(@days(CAST(o.o_orderdate AS DATE), q.dob) AS DOUBLE) / 365E0 AS age,
  CASE o.o_orderkey % 3 WHEN 0 THEN 'hospital' WHEN 1 THEN 'first_occurrence' ELSE 'clinic' END AS rep
FROM orders o JOIN fx_icd_pick p ON (o.o_orderkey * 7) % 13 = p.k
JOIN fx_patient q ON o.o_custkey = q.id""",
    # earliest matching diagnosis per patient and disease
    "onset": """
SELECT id, cohort, MIN(age) AS age, MIN(date) AS date FROM (
  SELECT g.id, d.cohort, g.age, g.date FROM fx_diagnosis g JOIN fx_disease_dict d
    ON g.icd_version = d.icd_version AND d.subs = 0 AND g.icd = d.icd
  UNION ALL
  SELECT g.id, d.cohort, g.age, g.date FROM fx_diagnosis g JOIN fx_disease_dict d
    ON g.icd_version = d.icd_version AND d.subs = 1 AND substring(g.icd, 1, 3) = substring(d.icd, 1, 3) AND substring(g.icd, 1, length(d.icd)) = d.icd AND length(d.icd) >= 3
  UNION ALL
  SELECT g.id, d.cohort, g.age, g.date FROM fx_diagnosis g JOIN fx_disease_dict d
    ON g.icd_version = d.icd_version AND d.subs = 1 AND substring(g.icd, 1, 2) = d.icd
) m GROUP BY id, cohort""",
    "lab": """
SELECT o.o_custkey AS id, CAST(100 + l.l_partkey % 8 AS INT) AS field, CAST(l.l_shipdate AS DATE) AS date,
  l.l_orderkey AS ord, l.l_linenumber AS ln, l.l_extendedprice AS value, q.sex,
  CAST(@days(CAST(l.l_shipdate AS DATE), q.dob) AS DOUBLE) / 365E0 AS age
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN fx_patient q ON o.o_custkey = q.id""",
    "unit_rule": """
SELECT * FROM (VALUES (100,''),(101,''),(102,'*0.5'),(103,'/10'),(104,'+3'),(105,''),(106,'*2.5'),(107,'')) AS t(field, action)""",
    "quantile_ref": """
SELECT CAST(100 + l.l_partkey % 8 AS INT) AS field, CAST(p.k AS DOUBLE) / 4E0 AS p,
  MIN(l.l_extendedprice) + (MAX(l.l_extendedprice) - MIN(l.l_extendedprice)) * CAST(p.k AS DOUBLE) / 4E0 AS value
FROM (SELECT l_partkey, l_extendedprice, @each(0, 1, 2, 3, 4) AS k FROM lineitem) p JOIN lineitem l ON 1 = 0 GROUP BY 1, 2, p.k""",
    "score": """
SELECT id, sex, CAST(age AS INT) AS age, name,
  CASE WHEN name <> 'longevity' AND (id + k) % 11 = 0 THEN NULL
       ELSE CAST((id * 7919 + age * 104729 + k * 1299709) % 1009 AS DOUBLE) / 1009E0 END AS score
FROM (
  SELECT id, sex, age, name, CASE name WHEN 'longevity' THEN 0 WHEN 'diabetes' THEN 1 WHEN 'ckd' THEN 2
    WHEN 'copd' THEN 3 WHEN 'cvd' THEN 4 ELSE 5 END AS k
  FROM (SELECT id, sex, age, @each('longevity', 'diabetes', 'ckd', 'copd', 'cvd', 'liver') AS name
    FROM (
      SELECT id, sex, start_age + step AS age FROM (
        SELECT id, sex, CASE id % 3 WHEN 0 THEN 45 WHEN 1 THEN 50 ELSE 55 END AS start_age, @each(0, 15, 30) AS step FROM fx_patient
      ) s WHERE start_age + step <= 80
    ) a) b) c""",
    # the same scores, one row per patient and age
    "pop": """
SELECT id, sex, age,
  MAX(CASE WHEN name = 'longevity' THEN score END) AS longevity,
  MAX(CASE WHEN name = 'diabetes' THEN score END) AS diabetes,
  MAX(CASE WHEN name = 'ckd' THEN score END) AS ckd,
  MAX(CASE WHEN name = 'copd' THEN score END) AS copd,
  MAX(CASE WHEN name = 'cvd' THEN score END) AS cvd,
  MAX(CASE WHEN name = 'liver' THEN score END) AS liver
FROM fx_score GROUP BY id, sex, age""",
    "marker": """
SELECT p_partkey AS m, concat('rs', CAST(p_partkey AS VARCHAR(20))) AS marker_id,
  CASE WHEN p_partkey % 23 = 0 THEN 'chrX' ELSE concat('chr', CAST(p_partkey % 23 AS VARCHAR(20))) END AS chrom,
  CAST(100000 + (p_partkey * 7919) % 20000000 AS INT) AS start_pos,
  CAST(100001 + (p_partkey * 7919) % 20000000 AS INT) AS end_pos,
  CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' ELSE 'T' END AS allele1,
  CASE p_partkey % 4 WHEN 0 THEN 'G' WHEN 1 THEN 'T' WHEN 2 THEN 'A' ELSE 'C' END AS allele2,
  CAST(5 + p_partkey % 40 AS INT) AS maf_pct
FROM part""",
    # one genotype per (patient, variant) pair seen together in the line items
    "dosage": """
SELECT concat('rs', CAST(l.l_partkey AS VARCHAR(20))) AS marker_id, o.o_custkey AS id,
  CASE WHEN (o.o_custkey * 31 + l.l_partkey * 17) % 211 = 0 THEN NULL ELSE
    CAST((CASE WHEN (o.o_custkey * 7919 + l.l_partkey * 104729 + (o.o_custkey * l.l_partkey) % 1013) % 100 < 5 + l.l_partkey % 40 THEN 1 ELSE 0 END)
       + (CASE WHEN (o.o_custkey * 6007 + l.l_partkey * 15485863 + (o.o_custkey * l.l_partkey) % 2027) % 100 < 5 + l.l_partkey % 40 THEN 1 ELSE 0 END) AS DOUBLE) END AS dosage
FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l JOIN orders o ON l.l_orderkey = o.o_orderkey
GROUP BY l.l_partkey, o.o_custkey""",
    "parents": """
SELECT id,
  CASE WHEN id % 5 <> 0 THEN CAST(30 + (id * 13) % 70 AS DOUBLE) END AS m_death_0,
  CASE WHEN id % 7 = 0 THEN CAST(-3 AS DOUBLE) END AS m_death_1,
  CASE WHEN id % 2 = 0 THEN CAST(55 + (id * 3) % 40 AS DOUBLE) END AS m_age_0,
  CASE WHEN id % 4 <> 0 THEN CAST(28 + (id * 17) % 70 AS DOUBLE) END AS f_death_0,
  CASE WHEN id % 3 = 0 THEN CAST(50 + (id * 7) % 45 AS DOUBLE) END AS f_age_0
FROM fx_patient""",
    # parents' follow-up as the survival operator returns it
    "parent_follow": """
SELECT id, LEAST(m_death_0, m_death_1) IS NOT NULL AS mdead, COALESCE(LEAST(m_death_0, m_death_1), m_age_0) AS mfollow_time,
  f_death_0 IS NOT NULL AS fdead, COALESCE(f_death_0, f_age_0) AS ffollow_time
FROM (SELECT id, f_death_0, f_age_0, m_age_0,
  COALESCE(m_death_0, m_death_1) AS m_death_0, COALESCE(m_death_1, m_death_0) AS m_death_1 FROM fx_parents) p""",
    "parent_long": """
SELECT id, 'father' AS parent, ffollow_time AS time, CASE WHEN fdead THEN 1 ELSE 0 END AS status FROM fx_parent_follow WHERE ffollow_time > 0
UNION ALL
SELECT id, 'mother' AS parent, mfollow_time AS time, CASE WHEN mdead THEN 1 ELSE 0 END AS status FROM fx_parent_follow WHERE mfollow_time > 0""",
    "track": """
SELECT user_id AS id, event_type AS track, CAST(@micros(ts) AS DOUBLE) / 3600000000E0 AS ts, event_id, value FROM events""",
    # administrative tracks: birth, death, registration, departure, absence
    "ehr": """
SELECT id, 'dob' AS track, MIN(ts) AS ts FROM fx_track GROUP BY id
UNION ALL SELECT id, 'register' AS track, MIN(ts) AS ts FROM fx_track WHERE track = 'signup' GROUP BY id
UNION ALL SELECT id, 'absent' AS track, ts FROM fx_track WHERE track = 'error'
UNION ALL SELECT id, 'lfg' AS track, MAX(ts) AS ts FROM fx_track WHERE track = 'purchase' GROUP BY id HAVING COUNT(*) >= 2
UNION ALL SELECT id, 'dod' AS track, MAX(ts) AS ts FROM fx_track WHERE track <> 'signup' GROUP BY id HAVING MAX(value) > 90""",
    # one anchor per patient and active day
    "anchor": """
SELECT DISTINCT id, FLOOR(ts / 24E0) * 24E0 + 12E0 AS t FROM fx_track""",
    "raw_wide": """
SELECT c_custkey AS eid, CAST(1 - c_custkey % 2 AS INT) AS sex_f31_0_0,
  CAST(1 + (c_custkey * 5) % 12 AS INT) AS month_of_birth_f52_0_0,
  CASE WHEN c_custkey % 97 <> 0 THEN CAST(1920 + (c_custkey * 7) % 31 AS INT) END AS year_of_birth_f34_0_0,
  CASE WHEN c_custkey % 4 = 1 THEN make_date(CAST(1999 + (c_custkey * 13) % 6 AS INT), CAST(1 + (c_custkey * 7) % 12 AS INT), CAST(1 + (c_custkey * 3) % 28 AS INT)) END AS date_of_death_f40000_0_0,
  CASE WHEN c_custkey % 8 IN (1, 2) THEN make_date(CAST(2000 + (c_custkey * 17) % 5 AS INT), CAST(1 + (c_custkey * 5) % 12 AS INT), CAST(1 + (c_custkey * 9) % 28 AS INT)) END AS date_of_death_f40000_1_0,
  CAST(1001 + c_custkey % 3 AS INT) AS ethnic_background_f21000_0_0,
  CASE WHEN c_custkey % 3 = 0 THEN CAST(1001 + c_custkey % 4 AS INT) END AS ethnic_background_f21000_1_0,
  make_date(CAST(1994 + c_custkey % 3 AS INT), CAST(1 + (c_custkey * 11) % 12 AS INT), CAST(1 + c_custkey % 28 AS INT)) AS date_of_attending_assessment_centre_f53_0_0,
  CASE WHEN c_custkey % 3 = 0 THEN make_date(CAST(1997 + c_custkey % 2 AS INT), CAST(1 + (c_custkey * 3) % 12 AS INT), CAST(1 + c_custkey % 27 AS INT)) END AS date_of_attending_assessment_centre_f53_1_0,
  CASE WHEN c_custkey % 9 = 0 THEN '<5' ELSE CAST(40 + c_custkey % 60 AS VARCHAR(10)) END AS assay_a_f30010_0_0,
  CASE WHEN c_custkey % 3 = 0 THEN CAST(42 + c_custkey % 55 AS VARCHAR(10)) END AS assay_a_f30010_1_0,
  CASE WHEN c_custkey % 4 <> 0 THEN CAST(10 + c_custkey % 17 AS VARCHAR(10)) END AS assay_b_f30020_0_0,
  CASE WHEN c_custkey % 2 = 0 THEN 'E119' WHEN c_custkey % 5 = 0 THEN 'J449' END AS diagnoses_f41270_0_0,
  CASE WHEN c_custkey % 2 = 0 OR c_custkey % 5 = 0 THEN make_date(CAST(1990 + c_custkey % 9 AS INT), 6, 15) END AS date_of_diagnosis_f41280_0_0,
  CASE WHEN c_custkey % 6 = 0 THEN 'I214' END AS diagnoses_f41270_0_1,
  CASE WHEN c_custkey % 6 = 0 THEN make_date(CAST(1992 + c_custkey % 7 AS INT), 3, 9) END AS date_of_diagnosis_f41280_0_1,
  CASE WHEN c_custkey % 7 = 0 THEN '4280' END AS diagnoses_f41271_0_0,
  CASE WHEN c_custkey % 7 = 0 THEN make_date(CAST(1980 + c_custkey % 11 AS INT), 2, 3) END AS date_of_diagnosis_f41281_0_0,
  CASE WHEN c_custkey % 5 = 1 THEN CAST(1220 + c_custkey % 4 AS VARCHAR(10)) END AS noncancer_illness_code_f20002_0_0,
  CASE WHEN c_custkey % 5 = 1 THEN CAST(c_custkey % 60 AS DOUBLE) - 1E0 END AS age_when_illness_diagnosed_f20009_0_0,
  CASE WHEN c_custkey % 10 = 3 THEN CAST(20 + c_custkey % 50 AS DOUBLE) END AS age_high_blood_pressure_f2966_0_0,
  CASE WHEN c_custkey % 6 = 1 THEN make_date(CAST(1985 + c_custkey % 12 AS INT), 7, 1) END AS date_e11_first_reported_f130708_0_0,
  CASE WHEN c_custkey % 8 = 2 THEN make_date(CAST(1983 + c_custkey % 15 AS INT), 8, 21) END AS date_j44_first_reported_f131492_0_0,
  CASE WHEN c_custkey % 12 = 5 THEN 'C509' END AS type_of_cancer_icd10_f40006_0_0,
  CASE WHEN c_custkey % 15 = 4 THEN '1749' END AS type_of_cancer_icd9_f40013_0_0,
  CASE WHEN c_custkey % 12 = 5 OR c_custkey % 15 = 4 THEN CAST(35 + c_custkey % 40 AS DOUBLE) END AS age_at_cancer_diagnosis_f40008_0_0,
  CASE WHEN c_custkey % 20 = 7 THEN CAST(1002 + c_custkey % 3 AS VARCHAR(10)) END AS cancer_code_selfreported_f20001_0_0,
  CASE WHEN c_custkey % 20 = 7 THEN CAST(30 + c_custkey % 45 AS DOUBLE) END AS interpolated_age_of_participant_when_cancer_first_diagnosed_f20007_0_0,
  CASE WHEN c_custkey % 5 <> 0 THEN CAST(30 + (c_custkey * 13) % 70 AS DOUBLE) END AS mothers_age_at_death_f3526_0_0,
  CASE WHEN c_custkey % 7 = 0 THEN CAST(-3 AS DOUBLE) END AS mothers_age_at_death_f3526_1_0,
  CASE WHEN c_custkey % 2 = 0 THEN CAST(55 + (c_custkey * 3) % 40 AS DOUBLE) END AS mothers_age_f1845_0_0,
  CASE WHEN c_custkey % 4 <> 0 THEN CAST(28 + (c_custkey * 17) % 70 AS DOUBLE) END AS fathers_age_at_death_f1807_0_0,
  CASE WHEN c_custkey % 3 = 0 THEN CAST(50 + (c_custkey * 7) % 45 AS DOUBLE) END AS fathers_age_f2946_0_0,
  CASE WHEN c_custkey % 8 <> 0 THEN CAST(1 + c_custkey % 5 AS VARCHAR(10)) END AS average_household_income_f738_0_0,
  CASE WHEN c_custkey % 3 = 0 THEN CAST(1 + c_custkey % 4 AS VARCHAR(10)) END AS average_household_income_f738_1_0
FROM customer""",
    "centers": """
SELECT * FROM (VALUES (1,0.9E0,0.1E0,0.1E0,0.1E0,0.1E0,0.1E0),(3,0.7E0,0.5E0,0.2E0,0.3E0,0.4E0,0.2E0),
  (7,0.5E0,0.5E0,0.5E0,0.5E0,0.5E0,0.5E0),(10,0.3E0,0.8E0,0.4E0,0.6E0,0.7E0,0.3E0),(12,0.4E0,0.2E0,0.8E0,0.7E0,0.3E0,0.8E0),
  (15,0.1E0,0.9E0,0.9E0,0.9E0,0.9E0,0.9E0)) AS t(clust, longevity, diabetes, ckd, copd, cvd, liver)""",
    # share of deaths by score bin, with the rows a lifelong table also carries
    "lifelong": """
SELECT s.name AS disease, s.sex, s.age, CAST(LEAST(CAST(FLOOR(s.score * 20E0) AS INT) + 1, 20) AS VARCHAR(4)) AS sbin,
  AVG(CASE WHEN p.dod_a IS NOT NULL OR p.dod_b IS NOT NULL THEN 1E0 ELSE 0E0 END) AS death
FROM fx_score s JOIN fx_patient p ON s.id = p.id WHERE s.score IS NOT NULL GROUP BY 1, 2, 3, 4
UNION ALL SELECT name, sex, age, 'death', 1E0 FROM fx_score GROUP BY name, sex, age
UNION ALL SELECT name, sex, age, 'no_cbc', 5E-1 FROM fx_score GROUP BY name, sex, age""",
    "assoc": """
SELECT trait, marker_id, chrom, start_pos, end_pos, allele1, allele2,
  CAST(maf_pct AS DOUBLE) / 100E0 AS freq,
  CAST((m * 7919 + k * 104729) % 2003 AS DOUBLE) / 1000E0 - 1E0 AS estim, CAST(2.5E-1 AS DOUBLE) AS std_err,
  (CAST((m * 7919 + k * 104729) % 2003 AS DOUBLE) / 1000E0 - 1E0) / 2.5E-1 AS score,
  -CAST((m * 6007 + k * 1299709) % 1200 AS DOUBLE) / 100E0 AS pval
FROM (SELECT m.*, CASE trait WHEN 'longevity' THEN 0 WHEN 'longevity_disease_covar' THEN 1 WHEN 'diabetes' THEN 2 WHEN 'ckd' THEN 3
    WHEN 'copd' THEN 4 WHEN 'cvd' THEN 5 WHEN 'liver' THEN 6 WHEN 'cox_both' THEN 7 WHEN 'cox_father' THEN 8 ELSE 9 END AS k
  FROM (SELECT *, @each('longevity', 'longevity_disease_covar', 'diabetes', 'ckd', 'copd', 'cvd', 'liver', 'cox_both', 'cox_father', 'cox_mother') AS trait FROM fx_marker) m) a""",
    "finemap": """
SELECT marker_id, substring(chrom, 4, 2) AS chr, start_pos AS bp, allele1 AS a1, allele2 AS a2,
  concat(chrom, ':', CAST(start_pos - start_pos % 1000000 AS VARCHAR(20)), '-', CAST(start_pos - start_pos % 1000000 + 3000000 AS VARCHAR(20)), ':', CAST(1 + m % 3 AS VARCHAR(4))) AS credible_set,
  CASE WHEN m % 5 <> 0 THEN CAST((m * 31) % 101 AS DOUBLE) / 101E0 END AS pip
FROM fx_marker""",
    "gene": """
SELECT s_suppkey AS gene_id, concat('chr', CAST(1 + s_suppkey % 22 AS VARCHAR(4))) AS chrom,
  CAST(50000 + (s_suppkey * 104729) % 20000000 AS INT) AS start_pos, CAST(50000 + (s_suppkey * 104729) % 20000000 + 5000 + s_suppkey % 90000 AS INT) AS end_pos,
  CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE concat('TRAIT', CAST(s_suppkey % 17 AS VARCHAR(4))) END AS trait
FROM supplier""",
    "covar": """
SELECT id, CAST(sex AS DOUBLE) AS sex, CAST((id * 37) % 101 AS DOUBLE) / 101E0 AS pc1, CAST((id * 53) % 89 AS DOUBLE) / 89E0 AS pc2 FROM fx_patient""",
    "surv": """
SELECT id, CAST(sex AS INT) AS grp, CAST(30 + (id * 13) % 70 AS DOUBLE) AS time,
  CASE WHEN id % 5 = 0 THEN 0 WHEN id % 7 = 0 THEN 2 ELSE 1 END AS status FROM fx_patient""",
    "hesin": """
SELECT o_custkey AS eid, o_orderkey AS ins_index,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN '' ELSE @dmy(o_orderdate) END AS epistart,
  @dmy(o_orderdate + INTERVAL 3 DAY) AS admidate
FROM orders""",
    "hesin_diag": """
SELECT o.o_custkey AS eid, l.l_orderkey AS ins_index,
  CASE WHEN p.icd_version = 10 THEN p.icd ELSE '' END AS diag_icd10, CASE WHEN p.icd_version = 9 THEN p.icd END AS diag_icd9
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN fx_icd_pick p ON (l.l_partkey + l.l_linenumber) % 13 = p.k""",
    "clinic": """
SELECT o_custkey AS eid, @dmy(o_orderdate) AS event_dt,
  CASE WHEN o_orderkey % 2 = 0 THEN concat('C', CAST(o_orderkey % 9 AS VARCHAR(4))) END AS read_2,
  CASE WHEN o_orderkey % 2 = 1 THEN concat('X', CAST(o_orderkey % 9 AS VARCHAR(4))) ELSE '' END AS read_3
FROM orders""",
    "read_map": """
SELECT concat('C', CAST(k AS VARCHAR(4))) AS coding, icd AS meaning FROM fx_icd_pick WHERE icd_version = 10""",
    "read3_map": """
SELECT concat('X', CAST(k AS VARCHAR(4))) AS coding, icd AS meaning FROM fx_icd_pick WHERE icd_version = 10""",
    "icd_names": """
SELECT icd AS coding, concat('name of ', icd) AS meaning, icd_version FROM fx_icd_pick
UNION ALL SELECT DISTINCT substring(icd, 1, 3), concat('group ', substring(icd, 1, 3)), icd_version FROM fx_icd_pick WHERE length(icd) > 3""",
    "self_map": """
SELECT * FROM (VALUES ('1220','E119'),('1221','J449'),('1223','I251')) AS t(coding, meaning)""",
    "portal_death": """
SELECT c_custkey AS eid, @dmy(make_date(CAST(2001 + c_custkey % 4 AS INT), CAST(1 + c_custkey % 12 AS INT), CAST(1 + c_custkey % 28 AS INT))) AS date_of_death
FROM customer WHERE c_acctbal < 0""",
}
VIEWS["quantile_ref"] = """
SELECT field, CAST(k AS DOUBLE) / 4E0 AS p, lo + (hi - lo) * CAST(k AS DOUBLE) / 4E0 AS value
FROM (SELECT field, lo, hi, @each(0, 1, 2, 3, 4) AS k FROM (
  SELECT field, MIN(value) AS lo, MAX(value) AS hi FROM fx_lab GROUP BY field) g) e"""


def _expand(text: str, dialect: str) -> str:
    spark = dialect == "spark"
    text = re.sub(r"@each\(([^)]*)\)", r"explode(array(\1))" if spark else r"unnest([\1])", text)
    text = re.sub(
        r"@micros\((\w+)\)",
        r"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', \1)" if spark else r"epoch_us(\1)",
        text,
    )
    text = _rewrite(text, "@days(", "datediff({0}, {1})" if spark else "date_diff('day', {1}, {0})")
    return _rewrite(text, "@dmy(", "date_format({0}, 'dd/MM/yyyy')" if spark else "strftime({0}, '%d/%m/%Y')")


def _rewrite(text: str, mark: str, pattern: str) -> str:
    """Replace calls of a macro whose arguments may hold nested calls."""
    while (hit := text.find(mark)) >= 0:
        start = at = hit + len(mark)
        depth, args = 0, []
        while depth >= 0:
            ch = text[at]
            depth += {"(": 1, ")": -1}.get(ch, 0)
            if (ch == "," and depth == 0) or depth < 0:
                args.append(text[start:at].strip())
                start = at + 1
            at += 1
        text = text[:hit] + pattern.format(*args) + text[at:]
    return text


def _needed(text: str) -> list[str]:
    """Views a text names, each after the views it needs itself."""
    found: list[str] = []

    def visit(body: str) -> None:
        for name in re.findall(r"\bfx_(\w+)", body):
            if name in VIEWS and name not in found:
                visit(VIEWS[name])
                if name not in found:
                    found.append(name)

    visit(text)
    return found


def with_views(sql: str, dialect: str = "duckdb") -> str:
    """Put the derived views a query names in front of it as WITH clauses."""
    views = [f"fx_{n} AS ({VIEWS[n].strip()})" for n in _needed(sql)]
    sql = sql.strip()
    if views:
        own = re.match(r"WITH\s+", sql, re.I)
        sql = "WITH " + ",\n".join(views) + (",\n" + sql[own.end() :] if own else "\n" + sql)
    return _expand(sql, dialect)


def table(spark: SparkSession, name: str, source) -> DataFrame:
    """The named view as a DataFrame; ``source(name)`` gives the given tables it reads."""
    text = with_views(f"SELECT * FROM fx_{name}", "spark")
    used = {}
    for s in SOURCES:
        text, hits = re.subn(rf"\b(FROM|JOIN)\s+{s}\b", rf"\1 {{{s}}}", text)
        if hits:
            used[s] = source(s)
    return spark.sql(text, **used) if used else spark.sql(text)
