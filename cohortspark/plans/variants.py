"""Association results: wide tables, fine-mapping, top variants, annotation, plot data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators import intervals
from cohortspark.operators.keys import natural_join
from cohortspark.operators.ordered import quantiles, ranked
from cohortspark.sources.stored import settle

GENOME_WIDE = 5e-8  # fixed value: usual significance threshold
FLANK = 500_000
MEDIAN_CHISQ1 = 0.454936423119572  # fixed value: median of chi-square with 1 df
VARIANT = ("marker_id", "allele1", "allele2")


def normal_chrom(chrom: Column) -> Column:
    """chr01 -> chr1."""
    return F.regexp_replace(chrom, "^chr0", "chr")


def chrom_rank(chrom: Column) -> Column:
    """1..22, X = 23, anything else after them."""
    text = F.regexp_replace(chrom, "^chr0?", "")
    return F.coalesce(text.try_cast("int"), F.when(text == "X", 23).otherwise(24))


def significant(results: DataFrame, pvalue: str = "pval", threshold: float = GENOME_WIDE) -> DataFrame:
    return results.filter(F.col(pvalue) <= F.log10(F.lit(threshold)))


def _best(pvalue: str, *rest: str) -> Column:
    """A result whose minimum has the lowest p-value; results without one come last."""
    return F.struct(F.col(pvalue).isNull().alias("unknown"), pvalue, *rest)


def assoc_wide(long: DataFrame, traits: Mapping[str, Sequence[str]], base: str) -> DataFrame:
    """One row per variant of the base trait, with <trait>_<measure> columns.

    ``traits`` maps a trait to its measures among pval, beta, score, stderr, z. Of repeated
    results the one with the lowest known p-value counts. One aggregate instead of a join per trait.
    """
    source = {"pval": "pval", "beta": "estim", "score": "score", "stderr": "std_err", "z": "score"}
    fields = ["pval", "estim", "score", "std_err"]
    mine = lambda t: F.min(F.when(F.col("trait") == t, _best(*fields))).alias(t)
    place = F.min(F.when(F.col("trait") == base, F.struct("chrom", "start_pos", "end_pos", "freq"))).alias("_at")
    names = list(traits)
    rows = long.filter(F.col("trait").isin(names)).groupBy(*VARIANT).agg(place, *[mine(t) for t in names])
    rows = rows.filter(F.col("_at").isNotNull())
    out = [F.col("_at.chrom"), F.col("_at.start_pos"), F.col("_at.end_pos"), *VARIANT, F.col("_at.freq")]
    for t, measures in traits.items():
        out += [F.col(f"`{t}`.{source[m]}").alias(f"{t}_{m}") for m in measures]
    return rows.select(*out)


def finemap_loci(results: DataFrame) -> DataFrame:
    """Split the credible set (chr:start-end:set) into locus and set number; keys as variants."""
    part = F.split("credible_set", "[^0-9A-Za-z]+")
    return results.select(
        F.concat(F.lit("chr"), "chr").alias("chrom"), F.col("bp").alias("start_pos"), F.col("a1").alias("allele1"),
        F.col("a2").alias("allele2"), F.concat_ws("_", part[0], part[1], part[2]).alias("locus"),
        part[3].alias("credible_set"), "pip")


def finemap_join(snps: DataFrame, results: DataFrame) -> DataFrame:
    return natural_join(snps, finemap_loci(results), on=["chrom", "start_pos", "allele1", "allele2"])


def regions(snps: DataFrame, flank: int = FLANK, lengths: Mapping[str, int] | None = None,
            slices: int | None = None) -> DataFrame:
    """Merged windows around the variants, with a region name."""
    windows = intervals.expand(intervals.centers(snps.select("chrom", "start_pos", "end_pos")), flank, lengths)
    merged = intervals.merge(windows, slices)
    return merged.withColumn("region", F.concat_ws("_", "chrom", "start_pos", "end_pos"))


def top_snps(snps: DataFrame, flank: int = FLANK, high: float = 0.5, lengths: Mapping[str, int] | None = None,
             slices: int | None = None) -> DataFrame:
    """Best variant of each region by pip, and every variant with a high pip.

    Adds region, n_locus and n_region. Counts and bests are aggregates joined back, so a
    region holding most of the variants stays spread.
    """
    snps = settle(snps, "snps")  # regions, places and counts read it
    placed = intervals.nearest(snps, regions(snps, flank, lengths, slices), "region", slices).drop("near_start", "near_end", "dist")
    rank = F.struct(F.col("pip").isNull().cast("int"), -F.coalesce("pip", F.lit(0.0)), F.col("start_pos"), *VARIANT)
    per_region = placed.groupBy("region").agg(
        F.count(F.lit(1)).alias("n_region"), F.min_by(F.struct(*VARIANT), rank).alias("_best"))
    per_locus = placed.groupBy("locus").agg(F.count(F.lit(1)).alias("n_locus"))
    rows = natural_join(placed, per_region, on=["region"])
    keep = (F.struct(*VARIANT) == F.col("_best")) | (F.col("pip") >= F.lit(high))
    return natural_join(rows.filter(keep).drop("_best"), per_locus, on=["locus"])


def neighbours_within(top: DataFrame, snps: DataFrame, flank: int = FLANK, lengths: Mapping[str, int] | None = None,
                      slices: int | None = None) -> DataFrame:
    """n_1M: other significant variants within the flank of each top variant."""
    top = settle(top.select(*VARIANT, "chrom", "start_pos", "end_pos"), "top")
    keys = top.withColumns({
        "orig_start": F.col("start_pos"), "orig_end": F.col("end_pos")})
    windows = intervals.expand(intervals.centers(keys), flank, lengths)
    counts = intervals.count_overlaps(windows, snps.select("chrom", "start_pos", "end_pos"), "n", slices)
    return counts.select(*VARIANT, "chrom", F.col("orig_start").alias("start_pos"), F.col("orig_end").alias("end_pos"),
                         (F.col("n") - 1).alias("n_1M"))


def attach_results(top: DataFrame, long: DataFrame, traits: Sequence[str], measures: Sequence[str] = ("pval", "z")) -> DataFrame:
    """Add the results of further traits to a variant table (union and one aggregate, one join)."""
    mine = long.filter(F.col("trait").isin(list(traits)))
    base = top.select(*VARIANT, "chrom", "start_pos", "end_pos")
    rows = mine.join(base, [*VARIANT, "chrom", "start_pos", "end_pos"], "left_semi")
    source = {"pval": "pval", "z": "score", "stat": "estim"}
    best = [F.min(F.when(F.col("trait") == t, _best("pval", "score", "estim"))).alias(t) for t in traits]
    wide = rows.groupBy(*VARIANT, "chrom", "start_pos", "end_pos").agg(*best)
    wide = wide.select(*VARIANT, "chrom", "start_pos", "end_pos", *[
        F.col(f"`{t}`.{source[m]}").alias(f"{t}_{m}") for t in traits for m in measures])
    return natural_join(top, wide, on=[*VARIANT, "chrom", "start_pos", "end_pos"])


def annotate(variants: DataFrame, genes: DataFrame, gene: str, trait: str, slices: int | None = None) -> DataFrame:
    """Nearest gene with its distance, and the distinct catalogue traits overlapping a variant.

    Traits are joined by comma in sorted order, null when there is none.
    """
    near = intervals.nearest(variants, genes, gene, slices).drop("near_start", "near_end")
    hits = intervals.overlap_join(variants.select("marker_id", "chrom", "start_pos", "end_pos"),
                                  genes.filter(F.col(trait).isNotNull()), [trait])
    traits = hits.select("marker_id", trait).distinct().groupBy("marker_id").agg(
        F.array_join(F.array_sort(F.collect_set(trait)), ",").alias("traits"))
    return near.join(traits, "marker_id", "left")


def qq(results: DataFrame, keys: Sequence[str] = ("trait",), pvalue: str = "pval", slices: int | None = None) -> DataFrame:
    """Observed and expected -log10 p per distinct p-value, ties at their mean rank."""
    ranks = ranked(results, keys, pvalue, slices=slices)
    rank = F.col("upto") - (F.col("n") - 1) / 2
    return ranks.select(*keys, "n", (-F.col(pvalue)).alias("observed"),
                        (-F.log10((rank - 0.5) / F.col("total"))).alias("expected"))


def inflation(results: DataFrame, keys: Sequence[str] = ("trait",), z: str = "score", slices: int | None = None) -> DataFrame:
    """Genomic inflation: median z squared over its expectation."""
    squares = results.select(*keys, (F.col(z) * F.col(z)).alias("chisq"))
    return quantiles(squares, keys, "chisq", [0.5], slices).select(*keys, "n", (F.col("chisq") / MEDIAN_CHISQ1).alias("lambda"))


def manhattan(results: DataFrame, points: int, pvalue: str = "pval") -> DataFrame:
    """The most significant points with their place along the whole genome."""
    order = chrom_rank(F.col("chrom"))
    lengths = results.groupBy("chrom").agg(F.max("end_pos").cast("long").alias("_len")).withColumn("_order", order)
    # one row per chromosome
    before = Window.partitionBy().orderBy("_order", "chrom").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lengths.select("chrom", F.coalesce(F.sum("_len").over(before), F.lit(0)).alias("_offset"))
    top = results.filter(F.col(pvalue).isNotNull()).orderBy(pvalue, *VARIANT).limit(points)
    return top.join(offsets, "chrom").select(
        *VARIANT, "chrom", "start_pos", (F.col("_offset") + F.col("start_pos")).alias("position"), (-F.col(pvalue)).alias("log_p"))


def select_variants(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Variants on the list, with the key chrom_pos_a1_a2."""
    kept = index.join(wanted.select("marker_id"), "marker_id", "left_semi")
    return kept.withColumn("variant_key", F.concat_ws("_", F.regexp_replace("chrom", "^chr", ""), "start_pos", "allele1", "allele2"))


def select_dosages(dosages: DataFrame, index: DataFrame, wanted: DataFrame, samples: DataFrame) -> DataFrame:
    """Dosage rows of the wanted variants and the numbered samples: variant_key, i, dosage."""
    keys = select_variants(index, wanted).select("marker_id", "variant_key")
    return dosages.join(keys, "marker_id").join(samples.select("id", "i"), "id").select("variant_key", "marker_id", "id", "i", "dosage")
