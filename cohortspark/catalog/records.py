"""Queries over scans, the raw table, diagnoses and onsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.catalog.registry import query
from cohortspark.functions.dates import age_on, date_at, days_between, parse_day_month_year
from cohortspark.functions.nulls import rounded
from cohortspark.operators.keys import exclude, natural_join, restrict
from cohortspark.plans import records
from cohortspark.session import scratch_dir
from cohortspark.sources import delimited, wide

day = lambda name: F.col(name).cast("string").alias(name)  # noqa: E731  dates leave as text

DICTIONARY = """
SELECT concat(substring(upper(p_name), 1, 1), CAST(10 + p_partkey % 90 AS VARCHAR(10))) AS icd,
  CAST(p_partkey % 2 AS INT) AS subs, p_type AS cohort, CAST(9 + p_size % 2 AS INT) AS icd_version FROM part"""


def _written(fx, df, name, sep=",", header=True):
    return delimited.write(df, scratch_dir(fx.spark, name), sep, header)


@query("scan_dictionary", f"SELECT DISTINCT * FROM ({DICTIONARY}) d")
def scan_dictionary(fx):
    name = F.upper(F.substring("p_name", 1, 1))
    raw = fx.source("part").select(
        F.concat(name, (F.lit(10) + F.col("p_partkey") % 90).cast("string")).alias("icd"),
        (F.col("p_partkey") % 2).cast("int").alias("subs"),
        F.col("p_type").alias("cohort"),
        (F.lit(9) + F.col("p_size") % 2).cast("int").alias("icd_version"),
    )
    return delimited.read_dictionary(fx.spark, _written(fx, raw, "dictionary"))


@query("dictionary_problems", f"""
SELECT icd, subs, cohort, icd_version, 'not a code' AS problem FROM (SELECT DISTINCT * FROM ({DICTIONARY}) d) e
WHERE icd_version = 9 AND NOT regexp_matches(icd, '^([0-9]{{3}}|[EV][0-9]{{2}})[0-9]{{0,2}}$')""")
def dictionary_problems(fx):
    return delimited.validate_dictionary(scan_dictionary(fx))


@query("load_exclude", """
SELECT eid, sex_f31_0_0, year_of_birth_f34_0_0 FROM fx_raw_wide
WHERE eid NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL)""")
def load_exclude(fx):
    withdrawn = fx.source("orders").filter("o_orderstatus = 'P'").select("o_custkey")
    return wide.load_exclude(fx("raw_wide"), withdrawn).select("eid", "sex_f31_0_0", "year_of_birth_f34_0_0")


@query("scan_tagged", """
SELECT o_orderstatus AS status, CAST(COUNT(*) AS BIGINT) AS n, round(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus""")
def scan_tagged(fx):
    path = scratch_dir(fx.spark, "tagged")
    orders = fx.source("orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("trait"))
    orders.write.partitionBy("trait").csv(path, header=True)
    rows = delimited.scan_tagged(
        fx.spark, f"{path}/*", "o_orderkey BIGINT, o_totalprice DOUBLE", r"trait=([^/]+)/", "status")
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("sample_index", "SELECT id, sex, CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS i FROM fx_patient")
def sample_index(fx):
    people = fx("patient").select(
        F.col("id").cast("string").alias("ID_1"), F.col("id").cast("string").alias("ID_2"),
        F.lit("0").alias("missing"), F.col("sex").cast("string").alias("sex"))
    type_row = people.agg(
        F.lit("0").alias("ID_1"), F.lit("0").alias("ID_2"), F.lit("0").alias("missing"), F.lit("D").alias("sex"))
    return delimited.sample_index(fx.spark, _written(fx, type_row.unionByName(people), "samples", " "))


@query("sample_anti", """
SELECT id, sex FROM fx_patient p WHERE NOT EXISTS (SELECT 1 FROM fx_dosage d WHERE d.id = p.id AND d.dosage >= 2)""")
def sample_anti(fx):
    return exclude(fx("patient").select("id", "sex"), fx("dosage").filter("dosage >= 2"))


@query("sumstats_import", """
SELECT variant, trait, chrom, CAST(start AS INTEGER) AS start, allele1, allele2, round(CASE WHEN p = 0 THEN -400 ELSE log10(p) END, 6) AS pval FROM (
  SELECT concat(substring(chrom, 4, 2), ':', CAST(start_pos AS VARCHAR), ':', allele1, ':', allele2) AS variant,
    arg_min(trait, (p, trait)) AS trait, MIN(chrom) AS chrom, MIN(start_pos) AS start, MIN(allele1) AS allele1, MIN(allele2) AS allele2, MIN(p) AS p
  FROM (SELECT *, CASE WHEN pval < -11.9 THEN 0 ELSE power(10, pval) END AS p FROM fx_assoc) a
  WHERE p < 1e-5 AND NOT pval > -0.5 GROUP BY 1) b""")
def sumstats_import(fx):
    table = fx("assoc").select(
        F.concat_ws(":", F.substring("chrom", 4, 2), "start_pos", "allele1", "allele2").alias("variant"),
        "trait", "estim", "std_err",
        F.when(F.col("pval") < -11.9, "0").when(F.col("pval") > -0.5, "NaN")
        .otherwise(F.pow(F.lit(10.0), F.col("pval")).cast("string")).alias("p"))
    path = _written(fx, table, "sumstats", "\t")
    schema = "variant STRING, trait STRING, estim DOUBLE, std_err DOUBLE, p DOUBLE"
    return delimited.import_sumstats(fx.spark, path, schema, "variant", "p", ["trait"]).withColumn("pval", rounded(F.col("pval")))


@query("sumstats_export", """
SELECT substring(chrom, 4, 2) AS CHR, start_pos AS BP, allele1 AS A1, allele2 AS A2, 328542 AS N,
  round(estim / std_err, 6) AS Z, pval AS P, marker_id AS SNP FROM fx_assoc WHERE chrom <> 'chrX' AND trait = 'longevity_disease_covar'""")
def sumstats_export(fx):
    rows = fx("assoc").filter("trait = 'longevity_disease_covar'")
    out = delimited.export_sumstats(rows, n=328542, pvalue="pval", name="marker_id").withColumn("Z", rounded(F.col("Z")))
    schema = "CHR STRING, BP INT, A1 STRING, A2 STRING, N INT, Z DOUBLE, P DOUBLE, SNP STRING"
    return delimited.scan(fx.spark, _written(fx, out, "ldsc", " "), schema, sep=" ")


@query("demog", """
SELECT eid AS id, 2 - sex_f31_0_0 AS sex, CAST(make_date(year_of_birth_f34_0_0, month_of_birth_f52_0_0, 1) AS VARCHAR) AS dob,
  ethnic_background_f21000_0_0 AS race_0, CAST(CAST(date_0 AS DATE) AS VARCHAR) AS date_0,
  round(@days(date_0, make_date(year_of_birth_f34_0_0, month_of_birth_f52_0_0, 1)) / 365.0, 6) AS age_0,
  round(@days(date_1, make_date(year_of_birth_f34_0_0, month_of_birth_f52_0_0, 1)) / 365.0, 6) AS age_1,
  CAST(COALESCE(LEAST(d0, d1), d0, d1, pd) AS VARCHAR) AS dod
FROM (SELECT *, date_of_attending_assessment_centre_f53_0_0 AS date_0, date_of_attending_assessment_centre_f53_1_0 AS date_1,
    date_of_death_f40000_0_0 AS d0, date_of_death_f40000_1_0 AS d1 FROM fx_raw_wide) r
LEFT JOIN (SELECT eid AS pid, MIN(strptime(date_of_death, '%d/%m/%Y')::DATE) AS pd FROM fx_portal_death GROUP BY 1) p ON p.pid = r.eid
WHERE sex_f31_0_0 IS NOT NULL AND year_of_birth_f34_0_0 IS NOT NULL AND month_of_birth_f52_0_0 IS NOT NULL""")
def demog(fx):
    d = records.demographics(fx("raw_wide"), fx("portal_death"))
    return d.select(
        "id", "sex", day("dob"), "race_0", day("date_0"),
        rounded(F.col("age_0")).alias("age_0"), rounded(F.col("age_1")).alias("age_1"), day("dod"))


DEMOG = """dm AS (SELECT eid AS id, 2 - sex_f31_0_0 AS sex, make_date(year_of_birth_f34_0_0, month_of_birth_f52_0_0, 1) AS dob,
  @days(date_of_attending_assessment_centre_f53_0_0, make_date(year_of_birth_f34_0_0, month_of_birth_f52_0_0, 1)) / 365.0 AS age_0,
  @days(date_of_attending_assessment_centre_f53_1_0, make_date(year_of_birth_f34_0_0, month_of_birth_f52_0_0, 1)) / 365.0 AS age_1
  FROM fx_raw_wide WHERE year_of_birth_f34_0_0 IS NOT NULL),
vis AS (SELECT id, sex, age_0 AS age, 0 AS timepoint FROM dm UNION ALL SELECT id, sex, age_1, 1 FROM dm)"""


@query("visits_long", f"WITH {DEMOG} SELECT id, sex, round(age, 6) AS age, timepoint FROM vis")
def visits_long(fx):
    return records.visits(records.demographics(fx("raw_wide"))).withColumn("age", rounded(F.col("age")))


@query("labs_long", f"""WITH {DEMOG}, cells AS (
  SELECT eid AS id, 30010 AS field, 'assay_a_f30010_0_0' AS feature_name, 0 AS timepoint, assay_a_f30010_0_0 AS v FROM fx_raw_wide
  UNION ALL SELECT eid, 30010, 'assay_a_f30010_1_0', 1, assay_a_f30010_1_0 FROM fx_raw_wide
  UNION ALL SELECT eid, 30020, 'assay_b_f30020_0_0', 0, assay_b_f30020_0_0 FROM fx_raw_wide)
SELECT c.id, c.field, c.feature_name, c.timepoint, TRY_CAST(c.v AS DOUBLE) AS value, CAST(v.sex AS DOUBLE) AS sex, round(v.age, 6) AS age
FROM cells c LEFT JOIN vis v ON c.id = v.id AND c.timepoint = v.timepoint AND v.age IS NOT NULL WHERE TRY_CAST(c.v AS DOUBLE) IS NOT NULL""")
def labs_long(fx):
    raw = fx("raw_wide")
    v = records.visits(records.demographics(raw))
    rows = records.lab_values(raw, [30010, 30020], v)
    return rows.withColumns({"age": rounded(F.col("age")), "sex": F.col("sex").cast("double")})


@query("socio_long", f"""WITH {DEMOG}, cells AS (
  SELECT eid AS id, 0 AS timepoint, average_household_income_f738_0_0 AS v FROM fx_raw_wide
  UNION ALL SELECT eid, 1, average_household_income_f738_1_0 FROM fx_raw_wide)
SELECT c.id, CAST(v.sex AS DOUBLE) AS sex, round(v.age, 6) AS age, CAST(c.v AS DOUBLE) AS socio
FROM cells c LEFT JOIN vis v ON c.id = v.id AND c.timepoint = v.timepoint AND v.age IS NOT NULL WHERE c.v IS NOT NULL""")
def socio_long(fx):
    raw = fx("raw_wide")
    rows = records.socio_values(raw, records.visits(records.demographics(raw)))
    return rows.withColumns({"age": rounded(F.col("age")), "sex": F.col("sex").cast("double")})


@query("paired_arrays", """
SELECT eid AS id, 0 AS instance, 0 AS arr, diagnoses_f41270_0_0 AS icd, CAST(date_of_diagnosis_f41280_0_0 AS VARCHAR) AS date FROM fx_raw_wide WHERE diagnoses_f41270_0_0 IS NOT NULL
UNION ALL SELECT eid, 0, 1, diagnoses_f41270_0_1, CAST(date_of_diagnosis_f41280_0_1 AS VARCHAR) FROM fx_raw_wide WHERE diagnoses_f41270_0_1 IS NOT NULL""")
def paired_arrays(fx):
    rows = wide.paired_fields(fx("raw_wide"), 41270, 41280, ("icd", "date"), ("string", "date"))
    return rows.select("id", "instance", "arr", "icd", day("date"))


FIRST = """fo AS (
  SELECT eid AS id, 'E11' AS icd, date_e11_first_reported_f130708_0_0 AS date, 'group E11' AS meaning FROM fx_raw_wide WHERE date_e11_first_reported_f130708_0_0 IS NOT NULL
  UNION ALL SELECT eid, 'J44', date_j44_first_reported_f131492_0_0, 'group J44' FROM fx_raw_wide WHERE date_j44_first_reported_f131492_0_0 IS NOT NULL)"""


@query("first_occurrence", f"WITH {FIRST} SELECT id, icd, CAST(date AS VARCHAR) AS date, meaning FROM fo")
def first_occurrence(fx):
    names = fx("icd_names").filter("icd_version = 10")
    return wide.first_occurrences(fx("raw_wide"), names).select("id", "icd", day("date"), "meaning")


EVENT = """ev AS (SELECT g.eid AS id, g.diag_icd10, g.diag_icd9,
  strptime(CASE WHEN h.epistart IS NULL OR h.epistart = '' THEN h.admidate ELSE h.epistart END, '%d/%m/%Y')::DATE AS date
  FROM fx_hesin_diag g LEFT JOIN fx_hesin h ON g.eid = h.eid AND g.ins_index = h.ins_index)"""


@query("event_date", f"WITH {EVENT} SELECT id, diag_icd10, diag_icd9, CAST(date AS VARCHAR) AS date FROM ev")
def event_date(fx):
    rows = records.event_dates(fx("hesin_diag"), fx("hesin"))
    return rows.select("id", "diag_icd10", "diag_icd9", day("date"))


CLINIC = """cl AS (
  SELECT c.eid AS id, m.meaning AS icd, strptime(c.event_dt, '%d/%m/%Y')::DATE AS date FROM fx_clinic c JOIN fx_read_map m ON c.read_2 = m.coding
  UNION ALL SELECT c.eid, m.meaning, strptime(c.event_dt, '%d/%m/%Y')::DATE FROM fx_clinic c JOIN fx_read3_map m ON c.read_3 = m.coding)"""


@query("code_map", f"WITH {CLINIC} SELECT id, icd, CAST(date AS VARCHAR) AS date FROM cl")
def code_map(fx):
    rows = records.code_map(fx("clinic"), fx("read_map"), "read_2").unionByName(
        records.code_map(fx("clinic"), fx("read3_map"), "read_3"))
    return rows.select("id", "icd", day("date"))


@query("diagnosis_union", f"""WITH {DEMOG}, {FIRST}, {EVENT}, {CLINIC}, hosp AS (
  SELECT id, icd, icd_version, MIN(date) AS date FROM (
    SELECT eid AS id, diagnoses_f41270_0_0 AS icd, 10 AS icd_version, date_of_diagnosis_f41280_0_0 AS date FROM fx_raw_wide WHERE diagnoses_f41270_0_0 IS NOT NULL
    UNION ALL SELECT eid, diagnoses_f41270_0_1, 10, date_of_diagnosis_f41280_0_1 FROM fx_raw_wide WHERE diagnoses_f41270_0_1 IS NOT NULL
    UNION ALL SELECT eid, diagnoses_f41271_0_0, 9, date_of_diagnosis_f41281_0_0 FROM fx_raw_wide WHERE diagnoses_f41271_0_0 IS NOT NULL
    UNION ALL SELECT id, diag_icd10, 10, date FROM ev WHERE diag_icd10 IS NOT NULL AND diag_icd10 <> ''
    UNION ALL SELECT id, diag_icd9, 9, date FROM ev WHERE diag_icd9 IS NOT NULL AND diag_icd9 <> '') h GROUP BY 1, 2, 3),
dated AS (
  SELECT h.id, h.icd, h.icd_version, h.date, n.meaning, 'hospital' AS rep FROM hosp h LEFT JOIN fx_icd_names n ON h.icd = n.coding AND h.icd_version = n.icd_version
  UNION ALL SELECT id, icd, 10, date, meaning, 'first_occurrence' FROM fo
  UNION ALL SELECT c.id, c.icd, 10, c.date, n.meaning, 'clinic' FROM cl c LEFT JOIN fx_icd_names n ON c.icd = n.coding AND n.icd_version = 10),
aged AS (
  SELECT r.eid AS id, m.meaning AS icd, r.age_when_illness_diagnosed_f20009_0_0 AS age, 'self_rep_nurse' AS rep FROM fx_raw_wide r
  JOIN fx_self_map m ON r.noncancer_illness_code_f20002_0_0 = m.coding WHERE r.age_when_illness_diagnosed_f20009_0_0 > 0
  UNION ALL SELECT eid, 'I10', age_high_blood_pressure_f2966_0_0, 'self_rep_touchscreen' FROM fx_raw_wide WHERE age_high_blood_pressure_f2966_0_0 > 1)
SELECT id, icd, icd_version, CAST(date AS VARCHAR) AS date, round(age, 6) AS age, meaning, rep FROM (
  SELECT d.id, d.icd, d.icd_version, d.date, @days(d.date, p.dob) / 365.0 AS age, d.meaning, d.rep FROM dated d LEFT JOIN dm p ON d.id = p.id
  UNION ALL SELECT a.id, a.icd, 10, CAST(p.dob + CAST(floor(a.age * 365) AS INTEGER) AS DATE), a.age, n.meaning, a.rep FROM aged a LEFT JOIN dm p ON a.id = p.id
    LEFT JOIN fx_icd_names n ON a.icd = n.coding AND n.icd_version = 10) u WHERE age > 0""")
def diagnosis_union(fx):
    raw, names = fx("raw_wide"), fx("icd_names")
    table = records.diagnosis_union(
        raw, records.demographics(raw), names,
        hospital_followup=records.event_dates(fx("hesin_diag"), fx("hesin")),
        clinic=records.clinic_diagnoses(fx("clinic"), fx("read_map"), fx("read3_map"), names),
        self_report=records.self_reported(raw, fx("self_map"), names),
        touch=records.touchscreen(raw, {2966: "I10"}, names),
    )
    return table.select("id", "icd", "icd_version", day("date"), rounded(F.col("age")).alias("age"), "meaning", "rep")


@query("disease_onset", "SELECT id, cohort, round(age, 6) AS age, CAST(date AS VARCHAR) AS date FROM fx_onset")
def disease_onset(fx):
    rows = records.disease_onset(fx("diagnosis"), fx("disease_dict"))
    return rows.select("id", "cohort", rounded(F.col("age")).alias("age"), day("date"))


@query("prefix_join", """
SELECT g.id, g.icd, g.icd_version, CAST(g.date AS VARCHAR) AS date, g.rep, d.cohort FROM fx_diagnosis g
JOIN fx_disease_dict d ON g.icd_version = d.icd_version AND d.subs = 1 AND starts_with(g.icd, d.icd)""")
def prefix_join(fx):
    rows = records.prefix_join(fx("diagnosis"), fx("disease_dict"))
    return rows.select("id", "icd", "icd_version", day("date"), "rep", "cohort")


@query("chronic_onset", """
SELECT id, round(MIN(age), 6) AS age FROM (
  SELECT id, age FROM fx_diagnosis g WHERE EXISTS (SELECT 1 FROM fx_disease_dict d WHERE d.icd_version = g.icd_version AND (d.icd = g.icd OR d.icd = substring(g.icd, 1, 3)))
  UNION ALL SELECT eid, interpolated_age_of_participant_when_cancer_first_diagnosed_f20007_0_0 FROM fx_raw_wide
  WHERE interpolated_age_of_participant_when_cancer_first_diagnosed_f20007_0_0 IS NOT NULL) u GROUP BY id""")
def chronic_onset(fx):
    ages = records.self_reported_cancer_ages(fx("raw_wide"))
    return records.chronic_onset(fx("diagnosis"), fx("disease_dict"), ages).withColumn("age", rounded(F.col("age")))


@query("cancer_events", """
SELECT eid AS id, type_of_cancer_icd10_f40006_0_0 AS coding, age_at_cancer_diagnosis_f40008_0_0 AS age, CAST(NULL AS VARCHAR) AS meaning, 'registry_icd10' AS source FROM fx_raw_wide WHERE type_of_cancer_icd10_f40006_0_0 IS NOT NULL
UNION ALL SELECT eid, type_of_cancer_icd9_f40013_0_0, age_at_cancer_diagnosis_f40008_0_0, NULL, 'registry_icd9' FROM fx_raw_wide WHERE type_of_cancer_icd9_f40013_0_0 IS NOT NULL
UNION ALL SELECT eid, cancer_code_selfreported_f20001_0_0, interpolated_age_of_participant_when_cancer_first_diagnosed_f20007_0_0, NULL, 'self_report' FROM fx_raw_wide WHERE cancer_code_selfreported_f20001_0_0 IS NOT NULL""")
def cancer_events(fx):
    return records.cancer_events(fx("raw_wide"), fx("icd_names"))


@query("cancer_codes", """
SELECT DISTINCT type_of_cancer_icd10_f40006_0_0 AS icd, 10 AS icd_version FROM fx_raw_wide WHERE type_of_cancer_icd10_f40006_0_0 IS NOT NULL
UNION ALL SELECT DISTINCT type_of_cancer_icd9_f40013_0_0, 9 FROM fx_raw_wide WHERE type_of_cancer_icd9_f40013_0_0 IS NOT NULL""")
def cancer_codes(fx):
    return records.cancer_codes(fx("raw_wide"))


@query("parents_survival", "SELECT id, mdead, mfollow_time, fdead, ffollow_time FROM fx_parent_follow")
def parents_survival(fx):
    return records.parents_survival(fx("raw_wide")).select("id", "mdead", "mfollow_time", "fdead", "ffollow_time")


@query("parents_long", """
SELECT l.id, l.parent, l.time, l.status, c.pc1, c.pc2 FROM fx_parent_long l JOIN fx_covar c ON l.id = c.id
WHERE l.time IS NOT NULL AND c.pc1 IS NOT NULL AND c.pc2 IS NOT NULL AND NOT (l.status = 1 AND l.time < 40)""")
def parents_long(fx):
    rows = records.parents_long(records.parents_survival(fx("raw_wide")))
    rows = natural_join(rows, fx("covar").select("id", "pc1", "pc2"))
    return rows.dropna("any").filter(~((F.col("status") == 1) & (F.col("time") < 40)))


@query("cohort_restrict", """
SELECT p.id, p.sex, c.pc1, c.pc2 FROM fx_patient p LEFT JOIN fx_covar c ON p.id = c.id
WHERE p.id IN (SELECT id FROM fx_score WHERE name = 'diabetes' AND score IS NOT NULL) AND p.id IN (SELECT id FROM fx_dosage WHERE dosage IS NOT NULL)""")
def cohort_restrict(fx):
    scored = fx("score").filter("name = 'diabetes' AND score IS NOT NULL")
    rows = restrict(fx("patient").select("id", "sex"), scored, fx("dosage").filter("dosage IS NOT NULL"))
    return natural_join(rows, fx("covar").select("id", "pc1", "pc2"))


@query("natural_join", """
SELECT a.id, a.sex, a.dod, b.visits FROM (SELECT id, sex, CAST(dod AS VARCHAR) AS dod FROM fx_demog) a
LEFT JOIN (SELECT id, CAST(dod AS VARCHAR) AS dod, CAST(COUNT(date_0) + COUNT(date_1) AS BIGINT) AS visits FROM fx_demog GROUP BY 1, 2) b
ON a.id = b.id AND a.dod IS NOT DISTINCT FROM b.dod""")
def null_safe_join(fx):
    d = fx("demog")
    seen = d.groupBy("id", "dod").agg((F.count("date_0") + F.count("date_1")).alias("visits"))
    return natural_join(d.select("id", "sex", "dod"), seen).withColumn("dod", F.col("dod").cast("string"))


@query("scalar_strings", """
SELECT marker_id, lower(a1) AS allele, concat_ws('_', chr, CAST(bp AS VARCHAR)) AS variant, split_part(credible_set, ':', 1) AS chrom_locus,
  regexp_replace(credible_set, 'chr0?', '') AS plain, substring(credible_set, 1, 3) AS head, replace(CAST(-bp AS VARCHAR), '-', 'minus') AS offset_name,
  CAST(regexp_matches(credible_set, '^chr[0-9]+:') AS INT) AS autosomal, TRY_CAST(chr AS INT)::DOUBLE AS chr_number FROM fx_finemap""")
def scalar_strings(fx):
    t = fx("finemap")
    return t.select(
        "marker_id",
        F.lower("a1").alias("allele"),
        F.concat_ws("_", "chr", "bp").alias("variant"),
        F.split("credible_set", ":")[0].alias("chrom_locus"),
        F.regexp_replace("credible_set", "chr0?", "").alias("plain"),
        F.substring("credible_set", 1, 3).alias("head"),
        F.regexp_replace((-F.col("bp")).cast("string"), "-", "minus").alias("offset_name"),
        F.col("credible_set").rlike("^chr[0-9]+:").cast("int").alias("autosomal"),
        F.col("chr").try_cast("int").cast("double").alias("chr_number"),
    )


@query("scalar_dates", """
SELECT id, round(@days(date_0, dob) / 365.0, 6) AS age, CAST(@days(date_1, date_0) AS DOUBLE) AS gap,
  CAST(CAST(dob + CAST(floor(@days(date_0, dob) / 365.0 * 365) AS INTEGER) AS DATE) AS VARCHAR) AS back,
  CAST(strptime(strftime(date_0, '%d-%m-%Y'), '%d-%m-%Y')::DATE AS VARCHAR) AS reparsed FROM fx_patient""")
def scalar_dates(fx):
    p = fx("patient")
    return p.select(
        "id",
        rounded(age_on(F.col("date_0"), F.col("dob"))).alias("age"),
        days_between(F.col("date_1"), F.col("date_0")).alias("gap"),
        date_at(age_on(F.col("date_0"), F.col("dob")), F.col("dob")).cast("string").alias("back"),
        parse_day_month_year(F.date_format("date_0", "dd-MM-yyyy")).cast("string").alias("reparsed"),
    )
