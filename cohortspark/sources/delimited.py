"""Delimited text in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions.numeric import log10_pvalue
from cohortspark.operators.ordered import ranked

DICTIONARY_SCHEMA = "icd STRING, subs INT, cohort STRING, icd_version INT"
SAMPLE_SCHEMA = "ID_1 STRING, ID_2 STRING, missing STRING, sex STRING"


def scan(spark: SparkSession, path, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """Delimited scan with a stated schema: no inference pass, codes keep leading zeros."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header)


def write(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> str:
    df.write.mode("errorifexists").csv(path, sep=sep, header=header)
    return path


def read_dictionary(spark: SparkSession, path) -> DataFrame:
    """Disease dictionary, repeated rows removed."""
    return scan(spark, path, DICTIONARY_SCHEMA).dropDuplicates()


def validate_dictionary(dictionary: DataFrame) -> DataFrame:
    """Entries that look wrong: prefixes under three characters, codes of an unknown shape."""
    short = (F.col("subs") == 1) & (F.length("icd") < 3)
    icd10 = F.col("icd").rlike("^[A-Z][0-9][0-9A-Z]{0,5}$")
    icd9 = F.col("icd").rlike("^([0-9]{3}|[EV][0-9]{2})[0-9]{0,2}$")
    shape = ~F.when(F.col("icd_version") == 10, icd10).otherwise(icd9)
    return dictionary.withColumn(
        "problem", F.when(short, "short prefix").when(shape, "not a code")
    ).filter(F.col("problem").isNotNull())


def scan_tagged(spark: SparkSession, path, schema: str, pattern: str, name: str = "name", sep: str = ",") -> DataFrame:
    """Many files as one table, each row tagged with a part of its file's path."""
    return scan(spark, path, schema, sep).withColumn(
        name, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    )


def sample_index(spark: SparkSession, path, slices: int | None = None) -> DataFrame:
    """id, sex, i from a sample file, without its type row; i numbers the samples by id."""
    rows = scan(spark, path, SAMPLE_SCHEMA, sep=" ")
    rows = rows.filter(F.col("sex").rlike("^-?[0-9]+$")).select(
        F.col("ID_1").cast("long").alias("id"), F.col("sex").cast("int").alias("sex")
    )
    numbered = ranked(rows, [], "id", weight="sex", slices=slices)
    return numbered.select("id", F.col("w").cast("int").alias("sex"), F.col("upto").alias("i"))


def import_sumstats(spark: SparkSession, path, schema: str, variant: str, pvalue: str, keep: list[str],
                    log10_below: float = -5.0, sep: str = "\t") -> DataFrame:
    """External association results below a p-value, one row per variant (its smallest p).

    The filter and the three-column projection reach the scan.
    """
    p = F.col(pvalue)
    rows = scan(spark, path, schema, sep=sep).select(variant, *keep, pvalue)
    rows = rows.filter(~F.isnan(p) & (p < F.lit(10.0 ** log10_below)))
    best = rows.groupBy(variant).agg(
        F.min(p).alias("p"), *[F.min_by(k, F.struct(pvalue, k)).alias(k) for k in keep]
    )
    part = F.split(variant, ":")
    return best.select(
        variant, *keep,
        F.concat(F.lit("chr"), part[0]).alias("chrom"),
        part[1].try_cast("int").alias("start"),
        part[2].alias("allele1"), part[3].alias("allele2"),
        log10_pvalue(F.col("p")).alias("pval"),
    )


def export_sumstats(results: DataFrame, n: int | None = None, beta: str = "estim", stderr: str = "std_err",
                    pvalue: str | None = None, name: str | None = None) -> DataFrame:
    """CHR, BP, A1, A2, Z (and N, P, SNP) for heritability and fine-mapping tools; no chrX."""
    cols = [
        F.regexp_replace("chrom", "^chr", "").alias("CHR"),
        F.col("start_pos").alias("BP"),
        F.col("allele1").alias("A1"),
        F.col("allele2").alias("A2"),
        (F.col(beta) / F.col(stderr)).alias("Z"),
    ]
    if n is not None:
        cols.insert(4, F.lit(n).alias("N"))
    if pvalue:
        cols.append(F.col(pvalue).alias("P"))
    if name:
        cols.append(F.col(name).alias("SNP"))
    return results.filter(F.col("chrom") != "chrX").select(*cols)
