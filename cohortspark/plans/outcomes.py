"""Follow-up of scored patients and the validation of their scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.nulls import ifelse
from cohortspark.functions.numeric import bucketize
from cohortspark.operators.ordered import BOUNDED
from cohortspark.operators.survival import cumulative_incidence, first_in_period, incidence_at, km

DECILES = tuple(i / 10 for i in range(11))
DISEASES = ("diabetes", "ckd", "copd", "cvd", "liver")
EXPOSURE_YEARS = 5.0


def patient_survival(patients: DataFrame, demog: DataFrame, death_censor: Column) -> DataFrame:
    """Follow-up from the visits within five years before the model age.

    patients: id, sex, age. Output adds dod, exp_age, exp_date (days since 1970, a mean),
    dead and follow_time in days. The few visits of a patient sit in one demographics row,
    so after the join on id everything is computed inside the row.
    """
    visits = [c.split("_")[1] for c in demog.columns if c.startswith("date_")]
    spans = F.array(*[
        F.struct(F.col(f"age_{v}").alias("age"), F.unix_date(F.col(f"date_{v}")).cast("double").alias("day"))
        for v in visits])
    history = demog.select("id", "dod", spans.alias("_visits"))
    rows = patients.select("id", "sex", "age").distinct().join(history, "id")
    gap = lambda v: F.col("age") - v["age"]
    near = F.filter("_visits", lambda v: (gap(v) >= 0) & (gap(v) <= EXPOSURE_YEARS))
    rows = rows.withColumn("_near", near).filter(F.size("_near") > 0)

    def mean(field: str) -> Column:
        total = F.aggregate("_near", F.lit(0.0), lambda acc, v: acc + v[field])
        return total / F.nullif(F.size("_near"), F.lit(0))  # the filter may be evaluated later

    end = F.unix_date(F.coalesce("dod", death_censor))
    return rows.select(
        "id", "sex", "age", "dod", mean("age").alias("exp_age"), mean("day").alias("exp_date"),
        F.col("dod").isNotNull().alias("dead"), (end - mean("day")).alias("follow_time"))


def disease_outcomes(
    patients: DataFrame, onsets: DataFrame, disease_censor: Column, diseases: Sequence[str] = DISEASES
) -> DataFrame:
    """One row per patient row and disease: onset, sick_at_exp, sick, disease_follow_time."""
    per_disease = F.explode(F.array(*[F.lit(d) for d in diseases]))
    rows = patients.select("*", per_disease.alias("disease"))
    first = onsets.filter(F.col("cohort").isin(list(diseases))).groupBy("id", F.col("cohort").alias("disease")).agg(
        F.min("age").alias("disease_age"), F.min("date").alias("disease_date"))
    joined = rows.join(first, ["id", "disease"], "left")
    onset = F.unix_date("disease_date").cast("double")
    dated = F.col("disease_date").isNotNull()
    before = (dated & (onset < F.col("exp_date"))) | (F.col("disease_age") < F.col("exp_age"))
    joined = joined.withColumns({"sick_at_exp": before, "sick": dated})
    follow = F.when(~dated, F.unix_date(disease_censor) - F.col("exp_date")).otherwise(
        ifelse(F.col("sick_at_exp"), 0.0, onset - F.col("exp_date")))
    return joined.withColumn("disease_follow_time", follow)


def km_10y(pop: DataFrame, survival: DataFrame, age: int = 60, slices: int = BOUNDED) -> DataFrame:
    """Ten-year survival by sex and longevity-quantile decile at one age."""
    rows = pop.filter(F.col("age") == age).select("id", "sex", "age", "longevity_q")
    rows = rows.join(survival.select("id", "sex", "age", "follow_time", "dead"), ["id", "sex", "age"], "left")
    rows = rows.withColumns({
        "qbin": bucketize(F.col("longevity_q"), DECILES, include_lowest=True), "status": F.col("dead").cast("int")})
    curve = km(rows.filter("qbin IS NOT NULL"), ["sex", "qbin"], "follow_time", "status", slices)
    at10 = first_in_period(curve, ["sex", "qbin"], F.floor(F.col("time") / 365), 10)
    return at10.withColumns({"age": F.lit(age), "x": 1 - (F.col("qbin") - 1) / F.lit(float(len(DECILES) - 1))})


def competing_status(sick: Column, dead: Column) -> Column:
    return F.when(sick, 1).when(dead, 2).when(~sick & ~dead, 0)


def cif_10y(pop: DataFrame, outcomes: DataFrame, age: int = 60, horizon: float = 3650.0,
            diseases: Sequence[str] = DISEASES, slices: int = BOUNDED) -> DataFrame:
    """Ten-year disease incidence, death competing, by disease, sex and score decile.

    Patients without a score (sick before their lab tests) are left out.
    """
    scores = pop.filter(F.col("age") == age).select(
        "id", "sex", "age", F.inline(F.array(*[
            F.struct(F.lit(d).alias("disease"), F.col(d).alias("value")) for d in diseases])))
    rows = scores.withColumn("qbin", bucketize(F.col("value"), DECILES, include_lowest=True)).filter("qbin IS NOT NULL")
    rows = rows.join(
        outcomes.select("id", "sex", "age", "disease", "follow_time", "disease_follow_time", "sick", "dead"),
        ["id", "sex", "age", "disease"], "left")
    observed = ifelse(F.col("follow_time") < F.col("disease_follow_time"), F.col("follow_time"), F.col("disease_follow_time"))
    rows = rows.withColumns({"time": observed, "status": competing_status(F.col("sick"), F.col("dead"))})
    groups = ["disease", "sex", "qbin"]
    curve = cumulative_incidence(rows, groups, slices=slices)
    return incidence_at(curve, groups, horizon)
