"""Queries over genomic intervals, association tables and top variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.catalog.registry import query
from cohortspark.functions.nulls import rounded
from cohortspark.operators import intervals, sampling
from cohortspark.plans import variants

V = ("marker_id", "allele1", "allele2")
TRAITS = {
    "longevity": ("pval", "beta", "score", "stderr"), "longevity_disease_covar": ("pval", "beta", "score", "stderr"),
    **{d: ("pval", "beta", "score") for d in ("diabetes", "ckd", "copd", "cvd", "liver")},
    **{c: ("pval", "z") for c in ("cox_both", "cox_father", "cox_mother")},
}
COX = ("cox_mother", "cox_father", "cox_both")
_SOURCE = {"pval": "pval", "beta": "estim", "score": "score", "stderr": "std_err", "z": "score"}
SNPS = """sig AS (SELECT marker_id, chrom, start_pos, end_pos, allele1, allele2, freq, pval FROM fx_assoc WHERE trait = 'longevity_disease_covar' AND pval <= log10(5e-8)),
fm AS (SELECT concat('chr', chr) AS chrom, bp AS start_pos, a1 AS allele1, a2 AS allele2, concat_ws('_', split_part(credible_set, ':', 1), split_part(split_part(credible_set, ':', 2), '-', 1), split_part(credible_set, '-', 2)[:-3]) AS locus,
  split_part(credible_set, ':', 3) AS credible_set, pip FROM fx_finemap),
snps AS (SELECT s.*, f.locus, f.credible_set, f.pip FROM sig s LEFT JOIN fm f ON f.chrom = s.chrom AND f.start_pos = s.start_pos AND f.allele1 = s.allele1 AND f.allele2 = s.allele2)"""
ISLANDS = """win AS (SELECT chrom, GREATEST(start_pos - 500000, 0) AS s, start_pos + 1 + 500000 AS e FROM {src}),
isl AS (SELECT *, SUM(CASE WHEN prev IS NULL OR s > prev THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT *, MAX(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM win) w),
reg AS (SELECT chrom, CAST(MIN(s) AS INTEGER) AS start_pos, CAST(MAX(e) AS INTEGER) AS end_pos FROM isl GROUP BY chrom, island)"""


@query("normal_chrom", """
SELECT marker_id, regexp_replace(concat('chr', lpad(chr, 2, '0')), '^chr0', 'chr') AS chrom FROM fx_finemap""")
def normal_chrom(fx):
    padded = F.concat(F.lit("chr"), F.lpad("chr", 2, "0"))
    return fx("finemap").select("marker_id", variants.normal_chrom(padded).alias("chrom"))


def significant(fx):
    rows = fx("assoc").filter("trait = 'longevity_disease_covar'")
    return variants.significant(rows).select("marker_id", "chrom", "start_pos", "end_pos", "allele1", "allele2", "freq", "pval")


def finemapped(fx):
    return variants.finemap_join(significant(fx), fx("finemap"))


@query("interval_center_expand", """
SELECT gene_id, chrom, CAST(GREATEST(floor((start_pos + end_pos) / 2) - 500000, 0) AS INTEGER) AS start_pos,
  CAST(LEAST(floor((start_pos + end_pos) / 2) + 1 + 500000, 15000000) AS INTEGER) AS end_pos FROM fx_gene""")
def interval_center_expand(fx):
    lengths = {f"chr{i}": 15_000_000 for i in range(1, 23)}
    return intervals.expand(intervals.centers(fx("gene").drop("trait")), 500_000, lengths)


@query("interval_merge", f"WITH {SNPS}, {ISLANDS.format(src='snps')} SELECT * FROM reg")
def interval_merge(fx):
    return variants.regions(significant(fx)).drop("region")


NEAR = """(SELECT q.*, g.gene_id AS lg, g.start_pos AS ls, g.end_pos AS le, row_number() OVER (PARTITION BY q.marker_id ORDER BY g.end_pos DESC, g.start_pos, g.gene_id DESC) AS rn
  FROM fx_marker q LEFT JOIN fx_gene g ON g.chrom = q.chrom AND g.start_pos <= q.start_pos) l
JOIN (SELECT q.marker_id, g.gene_id AS rg, g.start_pos AS rs, g.end_pos AS re, row_number() OVER (PARTITION BY q.marker_id ORDER BY g.start_pos, g.end_pos DESC, g.gene_id DESC) AS rn
  FROM fx_marker q LEFT JOIN fx_gene g ON g.chrom = q.chrom AND g.start_pos > q.start_pos) r ON l.marker_id = r.marker_id AND l.rn = 1 AND r.rn = 1"""
NEAREST = f"""near AS (SELECT marker_id, chrom, start_pos, end_pos, CAST(CASE WHEN left_wins THEN lg ELSE rg END AS DOUBLE) AS gene_id, CAST(CASE WHEN left_wins THEN ls ELSE rs END AS DOUBLE) AS near_start,
  CAST(CASE WHEN left_wins THEN le ELSE re END AS DOUBLE) AS near_end, CAST(CASE WHEN left_wins THEN gl ELSE gr END AS DOUBLE) AS dist FROM (
  SELECT *, lg IS NOT NULL AND (rg IS NULL OR gl <= gr) AS left_wins FROM (
    SELECT l.*, r.rg, r.rs, r.re, CASE WHEN le > l.start_pos THEN 0 ELSE l.start_pos - le + 1 END AS gl, CASE WHEN rs < l.end_pos THEN 0 ELSE rs - l.end_pos + 1 END AS gr FROM {NEAR}) a) b)"""


@query("interval_nearest", f"WITH {NEAREST} SELECT * FROM near")
def interval_nearest(fx):
    rows = intervals.nearest(fx("marker").select("marker_id", "chrom", "start_pos", "end_pos"), fx("gene"), "gene_id")
    return rows.withColumns({c: F.col(c).cast("double") for c in ("gene_id", "near_start", "near_end", "dist")})


@query("interval_overlap", """
SELECT m.marker_id, m.chrom, m.start_pos, m.end_pos, g.gene_id FROM fx_marker m JOIN fx_gene g ON g.chrom = m.chrom AND m.start_pos < g.end_pos AND g.start_pos < m.end_pos""")
def interval_overlap(fx):
    return intervals.overlap_join(fx("marker").select("marker_id", "chrom", "start_pos", "end_pos"), fx("gene"), ["gene_id"])


@query("interval_overlap_count", """
SELECT g.gene_id, g.chrom, g.start_pos, g.end_pos, CAST(COUNT(m.marker_id) AS BIGINT) AS n FROM fx_gene g
LEFT JOIN fx_marker m ON g.chrom = m.chrom AND m.start_pos < g.end_pos AND g.start_pos < m.end_pos GROUP BY 1, 2, 3, 4""")
def interval_overlap_count(fx):
    return intervals.count_overlaps(fx("gene").drop("trait"), fx("marker").select("chrom", "start_pos", "end_pos"))


_WIDE = ", ".join(f"MIN(CASE WHEN trait = '{t}' THEN {_SOURCE[m]} END) AS {t}_{m}" for t, ms in TRAITS.items() for m in ms)


@query("assoc_wide", f"""SELECT marker_id, allele1, allele2, MIN(chrom) AS chrom, MIN(start_pos) AS start_pos, MIN(end_pos) AS end_pos, MIN(freq) AS freq, {_WIDE}
FROM fx_assoc GROUP BY marker_id, allele1, allele2""")
def assoc_wide(fx):
    return variants.assoc_wide(fx("assoc"), TRAITS, "longevity")


@query("finemap_join", f"WITH {SNPS} SELECT * FROM snps")
def finemap_join(fx):
    return finemapped(fx)


@query("qc_counts", f"""WITH {SNPS} SELECT chrom, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(CAST(pip IS NULL AS INT)) AS BIGINT) AS missing FROM snps GROUP BY chrom""")
def qc_counts(fx):
    return finemapped(fx).groupBy("chrom").agg(F.count("*").alias("n"), F.sum(F.col("pip").isNull().cast("int")).alias("missing"))


TOP = f"""{SNPS}, {ISLANDS.format(src='snps')},
placed AS (SELECT s.*, concat_ws('_', r.chrom, CAST(r.start_pos AS VARCHAR), CAST(r.end_pos AS VARCHAR)) AS region FROM snps s JOIN reg r ON r.chrom = s.chrom AND s.start_pos >= r.start_pos AND s.start_pos < r.end_pos),
top AS (SELECT *, COUNT(*) OVER (PARTITION BY region) AS n_region, COUNT(*) OVER (PARTITION BY locus) AS n_locus,
  row_number() OVER (PARTITION BY region ORDER BY pip DESC NULLS LAST, start_pos, marker_id, allele1, allele2) AS i FROM placed QUALIFY i = 1 OR pip >= 0.5)"""


@query("top_snps", f"WITH {TOP} SELECT * EXCLUDE (i) FROM top")
def top_snps(fx):
    return variants.top_snps(finemapped(fx))


@query("snps_within_1mb", f"""WITH {TOP} SELECT t.marker_id, t.allele1, t.allele2, t.chrom, t.start_pos, t.end_pos, CAST(COUNT(*) - 1 AS BIGINT) AS n_1M FROM top t
JOIN snps s ON s.chrom = t.chrom AND s.start_pos < t.start_pos + 500001 AND s.end_pos > GREATEST(t.start_pos - 500000, 0) GROUP BY ALL""")
def snps_within_1mb(fx):
    snps = finemapped(fx)
    return variants.neighbours_within(variants.top_snps(snps), snps)


@query("top_snps_cox", f"""WITH {TOP} SELECT t.marker_id, t.region, t.pip, {", ".join(f"{c}.pval AS {c}_pval, {c}.score AS {c}_z, {c}.estim AS {c}_stat" for c in COX)} FROM top t
{" ".join(f"LEFT JOIN fx_assoc {c} ON {c}.trait = '{c}' AND {c}.marker_id = t.marker_id AND {c}.allele1 = t.allele1 AND {c}.allele2 = t.allele2" for c in COX)}""")
def top_snps_cox(fx):
    rows = variants.attach_results(variants.top_snps(finemapped(fx)), fx("assoc"), COX, ("pval", "z", "stat"))
    return rows.select("marker_id", "region", "pip", *[f"{c}_{m}" for c in COX for m in ("pval", "z", "stat")])


@query("annotate_catalog", f"""WITH {NEAREST}, hits AS (SELECT DISTINCT m.marker_id, g.trait FROM fx_marker m JOIN fx_gene g ON g.chrom = m.chrom AND m.start_pos < g.end_pos AND g.start_pos < m.end_pos WHERE g.trait IS NOT NULL)
SELECT n.marker_id, n.chrom, n.start_pos, n.end_pos, n.gene_id, n.dist, (SELECT string_agg(trait, ',' ORDER BY trait) FROM hits h WHERE h.marker_id = n.marker_id) AS traits FROM near n""")
def annotate_catalog(fx):
    rows = variants.annotate(fx("marker").select("marker_id", "chrom", "start_pos", "end_pos"), fx("gene"), "gene_id", "trait")
    return rows.withColumns({c: F.col(c).cast("double") for c in ("gene_id", "dist")})


@query("gwas_qq", """
SELECT trait, CAST(COUNT(*) AS BIGINT) AS n, round(-pval, 6) AS observed, round(-log10((AVG(rn) - 0.5) / MAX(total)), 6) AS expected FROM (
  SELECT trait, pval, row_number() OVER (PARTITION BY trait ORDER BY pval) AS rn, COUNT(*) OVER (PARTITION BY trait) AS total FROM fx_assoc) r GROUP BY trait, pval""")
def gwas_qq(fx):
    return variants.qq(fx("assoc")).withColumns({c: rounded(F.col(c)) for c in ("observed", "expected")})


@query("gwas_inflation", """
SELECT trait, CAST(COUNT(*) AS BIGINT) AS n, round(quantile_cont(score * score, 0.5) / 0.454936423119572e0, 6) AS lambda FROM fx_assoc GROUP BY trait""")
def gwas_inflation(fx):
    return variants.inflation(fx("assoc")).withColumn("lambda", rounded(F.col("lambda")))


_CHROM = "COALESCE(TRY_CAST(substring(chrom, 4) AS INT), 23)"


@query("gwas_manhattan", f"""WITH len AS (SELECT chrom, MAX(end_pos) AS n FROM fx_assoc WHERE trait = 'longevity' GROUP BY chrom),
off AS (SELECT chrom, CAST(COALESCE(SUM(n) OVER (ORDER BY {_CHROM} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM len)
SELECT a.marker_id, a.allele1, a.allele2, a.chrom, a.start_pos, o.o + a.start_pos AS position, -a.pval AS log_p FROM fx_assoc a JOIN off o ON o.chrom = a.chrom
WHERE a.trait = 'longevity' ORDER BY a.pval, a.marker_id, a.allele1, a.allele2 LIMIT 500""")
def gwas_manhattan(fx):
    return variants.manhattan(fx("assoc").filter("trait = 'longevity'"), 500)


@query("ntile_batches", f"""
SELECT marker_id, CAST(ntile(37) OVER w AS BIGINT) AS bin, CAST(floor((row_number() OVER w - 1) / 100) AS BIGINT) AS batch FROM fx_marker
WINDOW w AS (ORDER BY {_CHROM}, start_pos, marker_id)""")
def ntile_batches(fx):
    place = variants.chrom_rank(F.col("chrom")) * F.lit(1e9) + F.col("start_pos")
    rows = sampling.row_numbers(fx("marker").select("marker_id", "chrom", "start_pos"), place, ["marker_id"])
    return rows.select("marker_id", sampling.ntile(F.col("rn"), F.col("n_rows"), 37).alias("bin"),
                       F.floor((F.col("rn") - 1) / 100).alias("batch"))


@query("stratified_sample", """
SELECT id, icd, rep, CAST(date AS VARCHAR) AS date FROM (SELECT *, row_number() OVER (PARTITION BY icd ORDER BY md5(concat_ws('|', CAST(id AS VARCHAR), CAST(date AS VARCHAR), rep, 'seed')), id, date, rep) AS rn
FROM (SELECT DISTINCT id, icd, rep, date FROM fx_diagnosis) d) r WHERE rn <= 50""")
def stratified_sample(fx):
    rows = fx("diagnosis").select("id", "icd", "rep", "date").distinct()
    out = sampling.stratified_sample(rows, ["icd"], ["id", "date", "rep"], 50, "seed")
    return out.withColumn("date", F.col("date").cast("string"))


@query("variant_select", """
SELECT d.marker_id, d.id, s.i, d.dosage, concat_ws('_', substring(m.chrom, 4), CAST(m.start_pos AS VARCHAR), m.allele1, m.allele2) AS variant_key
FROM fx_dosage d JOIN fx_marker m ON m.marker_id = d.marker_id AND m.marker_id IN (SELECT marker_id FROM fx_assoc WHERE trait = 'longevity' AND pval <= log10(5e-8))
JOIN (SELECT id, row_number() OVER (ORDER BY id) AS i FROM fx_patient) s ON s.id = d.id""")
def variant_select(fx):
    wanted = variants.significant(fx("assoc").filter("trait = 'longevity'"))
    people = fx("patient").select("id")
    samples = sampling.row_numbers(people, F.col("id").cast("double"), ["id"], name="i").select("id", "i")
    return variants.select_dosages(fx("dosage"), fx("marker"), wanted, samples)
