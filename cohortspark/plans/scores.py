"""Score tables, their normal transforms and the phenotypes made from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.linear import combine, ols_coefficients
from cohortspark.functions.numeric import interpolate, with_qnorm
from cohortspark.operators.keys import assert_unique, first_per_key
from cohortspark.operators.ordered import with_ranks

DISEASES = ("diabetes", "ckd", "copd", "cvd", "liver")
ALIASES = {"ncvd": "cvd"}  # fixed values: older names of a score
LAST_AGE = 80  # too few patients; left out of phenotypes
TARGET_AGE = 60


def fold_mean(scores: DataFrame) -> DataFrame:
    """Mean over cross-validation folds: id, sex, age, name, score."""
    name = F.col("name")
    for old, new in ALIASES.items():
        name = F.when(name == old, new).otherwise(name)
    return scores.groupBy("id", "sex", "age", name.alias("name")).agg(F.avg("score").alias("score"))


def mask_sick(scores: DataFrame, onsets: DataFrame) -> DataFrame:
    """Null the disease score of patients whose disease began before the model age."""
    onset = onsets.groupBy("id", F.col("cohort").alias("name")).agg(F.min("age").alias("_onset"))
    joined = scores.join(onset, ["id", "name"], "left")
    kept = F.when(F.col("_onset").isNotNull() & (F.col("_onset") < F.col("age")), None).otherwise(F.col("score"))
    return joined.withColumn("score", kept).drop("_onset")


def longevity_q(pop: DataFrame, column: str = "longevity", slices: int | None = None) -> DataFrame:
    """Share of patients of the same age and sex with a score at or below this one."""
    return with_ranks(pop, ["age", "sex"], column, {f"{column}_q": F.col("upto") / F.col("total")}, slices=slices)


def score_table(scores: DataFrame, onsets: DataFrame, diseases: Sequence[str] = DISEASES,
                slices: int | None = None) -> DataFrame:
    """id, sex, age, longevity, longevity_q and one column per disease, masked where sick."""
    masked = mask_sick(fold_mean(scores), onsets)
    names = ["longevity", *diseases]
    wide = masked.groupBy("id", "sex", "age").pivot("name", names).agg(F.max("score"))
    return longevity_q(wide, slices=slices).select("id", "sex", "age", "longevity", "longevity_q", *diseases)


def rank_norm(df: DataFrame, keys: Sequence[str], value: str, output: str, slices: int | None = None) -> DataFrame:
    """Rank-based inverse normal: quantile of (mean rank - 3/8) / (n + 1/4) within the keys."""
    rank = F.col("upto") - (F.col("n") - 1) / F.lit(2.0)
    p = (rank - F.lit(0.375)) / (F.col("total") + F.lit(0.25))
    return with_qnorm(with_ranks(df, keys, value, {"_p": p}, slices=slices), "_p", output)


def closest_age(df: DataFrame, keys: Sequence[str], target: int = TARGET_AGE) -> DataFrame:
    """One row per key, the age nearest to the target; the younger of two equally near."""
    ranked = df.withColumn("_gap", F.abs(F.col("age") - F.lit(target)))
    return first_per_key(ranked, keys, ["_gap", "age"]).drop("_gap")


def longevity_phenotype(pop: DataFrame, slices: int | None = None) -> DataFrame:
    """id, sex, age, longevity, score: normal scores by age and sex, then one age per patient."""
    rows = pop.select("id", "sex", "age", "longevity").filter(F.col("age") != LAST_AGE)
    return closest_age(rank_norm(rows, ["age", "sex"], "longevity", "score", slices), ["id"])


def disease_phenotype(pop: DataFrame, diseases: Sequence[str] = DISEASES, slices: int | None = None) -> DataFrame:
    """id, sex, age, disease, score, score_norm: one age per patient and disease.

    The age is chosen first; then a missing score (already sick) becomes 1, then ranks.
    """
    long = pop.filter(F.col("age") != LAST_AGE).select(
        "id", "sex", "age", F.inline(F.array(*[
            F.struct(F.lit(d).alias("disease"), F.col(d).alias("score")) for d in diseases])))
    one = closest_age(long, ["id", "disease"]).fillna(1.0, subset=["score"])
    return rank_norm(one, ["disease", "age", "sex"], "score", "score_norm", slices)


def covariates(phenotype: DataFrame, disease_scores: DataFrame, diseases: Sequence[str] = DISEASES) -> DataFrame:
    """id, age, sex and the normal disease scores at the phenotype's age."""
    wide = disease_scores.groupBy("id", "age").pivot("disease", list(diseases)).agg(F.max("score_norm"))
    return phenotype.select("id", "age", "sex").join(wide, ["id", "age"], "left")


def checked_covariates(phenotype: DataFrame, disease_scores: DataFrame, diseases: Sequence[str] = DISEASES) -> DataFrame:
    """As ``covariates``, failing when a patient would appear twice."""
    return assert_unique(covariates(phenotype, disease_scores, diseases), ["id"])


def score_residual(pop: DataFrame, diseases: Sequence[str] = DISEASES, target: str = "longevity_q") -> DataFrame:
    """Longevity quantile minus its least-squares prediction from age, sex and disease scores."""
    filled = pop.fillna(1.0, subset=list(diseases)).filter(F.col(target).isNotNull())
    design = [F.lit(1.0), F.col("age").cast("double"), F.col("sex").cast("double"), *[F.col(d) for d in diseases]]
    prediction = combine(design, ols_coefficients(filled, design, F.col(target)))
    return filled.withColumn("prediction", prediction).withColumn("residual_q", F.col(target) - F.col("prediction"))


def lifelong_risk(table: DataFrame, bins: int = 20) -> DataFrame:
    """Lifelong risk rows with their score range; rows without a lab test are dropped."""
    top = F.col("sbin").try_cast("double") / F.lit(float(bins))
    return table.filter(F.col("sbin") != "no_cbc").withColumns({"qmax": top, "qmin": top - F.lit(1.0 / bins)})


def lifelong_knots(table: DataFrame, bins: int = 20) -> DataFrame:
    """Per sex and age the curve of risk over score quantile (as many knots as bins, plus ends)."""
    rows = lifelong_risk(table, bins).filter((F.col("sbin") != "death") & F.col("qmax").isNotNull())
    knot = F.struct(((F.col("qmin") + F.col("qmax")) / 2).alias("x"), F.col("death").alias("y"))
    grouped = rows.groupBy("sex", "age").agg(
        F.array_sort(F.collect_list(knot)).alias("inner"), F.min("death").alias("lo"), F.max("death").alias("hi"))
    ends = lambda x, y: F.array(F.struct(F.lit(x).alias("x"), F.col(y).alias("y")))
    return grouped.select("sex", "age", F.concat(ends(0.0, "lo"), F.col("inner"), ends(1.0, "hi")).alias("knots"))


def lifelong_longevity(pop: DataFrame, table: DataFrame, quantile: str = "longevity_q", bins: int = 20) -> DataFrame:
    """Add risk: the lifelong table read at the patient's score quantile."""
    joined = pop.join(lifelong_knots(table, bins), ["sex", "age"], "left")
    return joined.withColumn("risk", interpolate(F.col(quantile), F.col("knots"))).drop("knots")


FLIP_X = (45, 50, 55, 70)  # fixed values: ages whose projection axes point the other way
FLIP_Y = (55, 60, 70)


def projection_long(projected: DataFrame, scores: Sequence[str]) -> DataFrame:
    """Projected coordinates with one row per score, axes turned to one orientation."""
    turn = lambda c, ages: F.when(F.col("age").isin(*ages), -F.col(c)).otherwise(F.col(c))
    turned = projected.withColumns({"x": turn("x", FLIP_X), "y": turn("y", FLIP_Y)})
    keep = [c for c in projected.columns if c not in scores]
    return turned.unpivot(keep, list(scores), "variable", "value")
