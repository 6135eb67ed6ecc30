"""Laboratory values: units, healthy-reference quantiles, reference tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.numeric import bucketize, interpolate
from cohortspark.operators.ordered import quantiles, with_ranks

AGE_BREAKS = tuple(range(35, 90, 5))
MIN_HEALTHY = 10


def unit_fix(labs: DataFrame, rules: DataFrame) -> DataFrame:
    """Apply ``value <op> constant`` of each lab's rule (field, action); blank leaves it."""
    parts = rules.withColumns({
        "_op": F.regexp_extract("action", r"^\s*([-+*/])", 1),
        "_by": F.regexp_extract("action", r"([0-9.eE+-]*[0-9.])\s*$", 1).try_cast("double"),
    })
    v, by = F.col("value"), F.col("_by")
    # an operand such as "+3" keeps its sign in the operator
    by = F.when(F.col("_op").isin("+", "-"), F.abs(by)).otherwise(by)
    fixed = (
        F.when(F.col("_op") == "*", v * by).when(F.col("_op") == "/", v / by)
        .when(F.col("_op") == "+", v + by).when(F.col("_op") == "-", v - by).otherwise(v)
    )
    return labs.join(parts, "field", "left").withColumn("value", fixed).drop("_op", "_by", "action")


def with_health(labs: DataFrame, chronic: DataFrame, age_breaks: Sequence[float] = AGE_BREAKS) -> DataFrame:
    """Add the age group and whether the value precedes the patient's first chronic disease."""
    onset = chronic.select("id", F.col("age").alias("_dx"))
    joined = labs.join(onset, "id", "left")
    healthy = F.when(F.col("_dx").isNull() | (F.col("_dx") > F.col("age")), 1).when(F.col("_dx") <= F.col("age"), 0)
    return joined.withColumns({"age_group": bucketize(F.col("age"), age_breaks), "healthy": healthy}).drop("_dx")


def normalize_labs(
    labs: DataFrame, chronic: DataFrame, age_breaks: Sequence[float] = AGE_BREAKS,
    keys: Sequence[str] = ("field",), slices: int | None = None,
) -> DataFrame:
    """Add q: the share of healthy values at or below this one, by lab, age group and sex.

    Null when the group has fewer than ten healthy values. Rows without sex are dropped.
    """
    rows = with_health(labs.filter(F.col("sex").isNotNull()), chronic, age_breaks)
    q = F.when(F.col("w_total") >= MIN_HEALTHY, F.col("w_upto") / F.col("w_total"))
    return with_ranks(rows, [*keys, "age_group", "sex"], "value", {"q": q}, weight="healthy", slices=slices)


def lab_quantiles(
    labs: DataFrame, chronic: DataFrame, probs: Sequence[float], age_breaks: Sequence[float] = AGE_BREAKS,
    keys: Sequence[str] = ("field",), slices: int | None = None,
) -> DataFrame:
    """Quantiles of the healthy values per lab, age group and sex with at least ten of them."""
    rows = with_health(labs.filter(F.col("sex").isNotNull()), chronic, age_breaks).filter("healthy = 1")
    table = quantiles(rows, [*keys, "age_group", "sex"], "value", probs, slices)
    return table.filter(F.col("n") >= MIN_HEALTHY)


def reference_quantile(
    labs: DataFrame, reference: DataFrame, keys: Sequence[str] = ("field",), clamp: bool = True
) -> DataFrame:
    """Add q by interpolating in a reference table of (keys, p, value) knots.

    The reference holds a fixed number of knots per lab. Values beyond the outermost knots
    take their p, or null without ``clamp``.
    """
    knots = reference.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("value").alias("x"), F.col("p").alias("y")))).alias("_knots"))
    joined = labs.join(knots, list(keys), "left")
    x, table = F.col("value"), F.col("_knots")
    q = interpolate(x, table)
    if clamp:
        q = (
            F.when(x <= F.element_at(table, 1)["x"], F.element_at(table, 1)["y"])
            .when(x >= F.element_at(table, -1)["x"], F.element_at(table, -1)["y"]).otherwise(q)
        )
    return joined.withColumn("q", q).drop("_knots")
