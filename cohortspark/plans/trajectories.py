"""Movement between score bins from one model age to the next, and its end points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.numeric import bucketize
from cohortspark.operators.keys import natural_join
from cohortspark.sources.stored import settle

NO_SCORE, DEATH, DISEASE, DISEASE_DEATH = "no_score", "death", "disease", "disease_death"
TERMINAL = {"mortality": (DEATH,), "disease": (DEATH, DISEASE, DISEASE_DEATH)}
DECILES = tuple(i / 10 for i in range(11))


def vital_status(demog: DataFrame, censor: Column) -> DataFrame:
    """id, death_age (null when alive) and last_age, the age reached by the censor date."""
    years = lambda d: F.datediff(d, F.col("dob")) / F.lit(365.0)
    return demog.select("id", years(F.col("dod")).alias("death_age"), years(F.coalesce("dod", censor)).alias("last_age"))


def _steps(pop: DataFrame, score: str, step: int, breaks: Sequence[float]) -> DataFrame:
    """id, sex, age, sbin and the bin ``step`` years later.

    Each row is sent to its own age and to the age a step younger, so that one aggregate
    brings both together.
    """
    bins = bucketize(F.col(score), breaks, include_lowest=True).cast("string")
    both = F.array(
        F.struct(F.col("age").alias("age"), F.coalesce(bins, F.lit(NO_SCORE)).alias("sbin"), F.lit(None).cast("string").alias("later")),
        F.struct((F.col("age") - step).alias("age"), F.lit(None).cast("string").alias("sbin"), F.coalesce(bins, F.lit(NO_SCORE)).alias("later")))
    rows = pop.select("id", "sex", score, "age").select("id", "sex", F.inline(both))
    return rows.groupBy("id", "sex", "age").agg(F.max("sbin").alias("sbin"), F.max("later").alias("later")).filter("sbin IS NOT NULL")


def _normalised(states: DataFrame) -> DataFrame:
    counts = states.filter("next IS NOT NULL").groupBy("sex", "age", "sbin", "next").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("sex", "age", "sbin"))  # a few states per group
    return counts.withColumn("p", F.col("n") / total)


def mortality_transitions(
    pop: DataFrame, vital: DataFrame, step: int, score: str = "longevity_q", breaks: Sequence[float] = DECILES,
    condition: Column | None = None,
) -> DataFrame:
    """P(next bin, death or no_score) per sex, age and bin.

    Rows followed for less than the step without dying are left out.
    """
    if condition is not None:
        pop = pop.filter(condition)
    rows = _steps(pop, score, step, breaks).join(vital, "id")
    until = F.col("age") + step
    died = F.col("death_age").isNotNull() & (F.col("death_age") <= until)
    state = F.when(died, DEATH).when(F.col("later").isNotNull(), F.col("later")).when(F.col("last_age") >= until, NO_SCORE)
    return _normalised(rows.filter(F.col("death_age").isNull() | (F.col("death_age") > F.col("age"))).withColumn("next", state))


def disease_transitions(
    pop: DataFrame, vital: DataFrame, onsets: DataFrame, step: int, score: str, breaks: Sequence[float] = DECILES,
    condition: Column | None = None,
) -> DataFrame:
    """As for mortality, with the disease and dying in the disease's first step as end points.

    onsets: id, onset_age. Patients already sick are left out.
    """
    if condition is not None:
        pop = pop.filter(condition)
    rows = _steps(pop, score, step, breaks).join(vital, "id").join(onsets.select("id", "onset_age"), "id", "left")
    until = F.col("age") + step
    died = F.col("death_age").isNotNull() & (F.col("death_age") <= until)
    sick = F.col("onset_age").isNotNull() & (F.col("onset_age") <= until)
    state = (
        F.when(sick & died, DISEASE_DEATH).when(sick, DISEASE).when(died, DEATH)
        .when(F.col("later").isNotNull(), F.col("later")).when(F.col("last_age") >= until, NO_SCORE))
    alive = F.col("death_age").isNull() | (F.col("death_age") > F.col("age"))
    well = F.col("onset_age").isNull() | (F.col("onset_age") > F.col("age"))
    return _normalised(rows.filter(alive & well).withColumn("next", state))


def transition_matrix(transitions: DataFrame, states: Sequence[str]) -> DataFrame:
    """One column per next state; for disease models also total_disease."""
    wide = transitions.groupBy("sex", "age", "sbin").pivot("next", list(states)).agg(F.max("p")).fillna(0.0)
    if DISEASE in states:
        wide = wide.withColumn("total_disease", F.col(DISEASE) + F.col(DISEASE_DEATH))
    return wide


def lifelong(transitions: DataFrame, step: int, target: Sequence[str] = (DEATH,), terminal: Sequence[str] = (DEATH,)) -> DataFrame:
    """Probability of ever reaching a target state, per sex, age and bin.

    Chained from the oldest age down: v = P(target) + sum over bins of P(bin) * v(bin, older).
    Bins unknown at the older age are left out and the rest rescaled. The transitions are
    written once; every age is computed once, from the written result of the age a step
    older.
    """
    table = settle(transitions.select("sex", "age", "sbin", "next", "p"), "transitions")
    ages = sorted((r[0] for r in table.select("age").distinct().collect()), reverse=True)
    levels: dict[int, DataFrame] = {}
    for age in ages:
        rows = table.filter(F.col("age") == age)
        ends = F.col("next").isin(list(terminal))
        hit = F.col("next").isin(list(target)).cast("double")
        older = levels.get(age + step)
        if older is None:  # at the last age a survivor is a survivor
            known = rows.withColumn("_v", F.when(ends, hit).otherwise(0.0))
        else:
            later = older.select("sex", F.col("sbin").alias("next"), F.col("risk").alias("v"))
            known = rows.join(later, ["sex", "next"], "left").withColumn("_v", F.when(ends, hit).otherwise(F.col("v")))
        level = known.filter("_v IS NOT NULL").groupBy("sex", "age", "sbin").agg((F.sum(F.col("p") * F.col("_v")) / F.sum("p")).alias("risk"))
        levels[age] = settle(level, "risks")
    done = None
    for level in levels.values():
        done = level if done is None else done.unionByName(level)
    if done is None:
        raise ValueError("no transitions")
    return natural_join(table.select("sex", "age", "sbin").distinct(), done)
