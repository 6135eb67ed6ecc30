"""Survival estimates over tables of any size.

Rows are counted per (group, time) before anything else, so a curve is computed from at
most one row per distinct time, whatever the number of people behind it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.functions.numeric import chisq_pvalue, log_erfc
from cohortspark.operators.keys import natural_join
from cohortspark.operators.ordered import BOUNDED, quantile_slices, running

Z95 = 1.959963984540054  # fixed value: normal quantile of 0.975


def life_table(df: DataFrame, groups: Sequence[str], time: str = "time", status: str = "status",
               slices: int = BOUNDED, weight: Column | None = None) -> tuple[DataFrame, str | None]:
    """Per group and time: n leaving, d1 events, d2 competing events, at_risk.

    Rows without time or status do not count. Returns the table and its slice column.
    """
    one = F.lit(1) if weight is None else weight
    event = lambda code: F.sum(F.when(F.col(status) == code, one).otherwise(0))
    counts = (
        df.filter(F.col(time).isNotNull() & F.col(status).isNotNull())
        .groupBy(*groups, F.col(time).alias("time"))
        .agg(F.sum(one).alias("n"), event(1).alias("d1"), event(2).alias("d2"))
    )
    counts, slice_col = quantile_slices(counts, "time", slices)
    table = running(counts, groups, [F.col("time")], {"_upto": ("sum", "n")}, slice_col, totals={"_total": "n"})
    at_risk = (F.col("_total") - F.col("_upto") + F.col("n")).cast("double")  # products of counts overflow longs
    return table.withColumn("at_risk", at_risk).drop("_upto", "_total"), slice_col


def km(df: DataFrame, groups: Sequence[str], time: str = "time", status: str = "status",
       slices: int = BOUNDED) -> DataFrame:
    """Kaplan-Meier curve: surv, std_err (of log surv, Greenwood), log-type 95% limits.

    One row per group and observed time, censoring times included.
    """
    table, slice_col = life_table(df, groups, time, status, slices)
    return _curve(table, groups, slice_col)


def _curve(table: DataFrame, groups: Sequence[str], slice_col: str | None) -> DataFrame:
    n, d = F.col("at_risk"), F.col("d1")
    steps = table.withColumns({
        "_log": F.when(d < n, F.log1p(-d / n)).otherwise(0.0),
        "_green": F.when(d < n, d / (n * (n - d))).otherwise(0.0),
        "_end": (d == n).cast("int"),
    })
    sums = running(steps, groups, [F.col("time")],
                   {"_ls": ("sum", "_log"), "_gs": ("sum", "_green"), "_dead": ("max", "_end")}, slice_col)
    alive = F.col("_dead") == 0
    surv = F.when(alive, F.exp("_ls")).otherwise(0.0)
    se = F.when(alive, F.sqrt("_gs"))
    return sums.select(
        *groups, "time", "at_risk", F.col("d1").alias("events"), (F.col("n") - F.col("d1")).alias("censored"),
        surv.alias("surv"), se.alias("std_err"),
        F.when(alive, surv * F.exp(-Z95 * se)).alias("lower"),
        F.when(alive, F.least(surv * F.exp(Z95 * se), F.lit(1.0))).alias("upper"),
    )


def first_in_period(curve: DataFrame, groups: Sequence[str], period: Column, at: int) -> DataFrame:
    """First curve row of each group whose period number is ``at`` (e.g. whole years)."""
    rest = [c for c in curve.columns if c not in groups]
    rows = curve.filter(period == at).groupBy(*groups).agg(F.min_by(F.struct(*rest), "time").alias("_r"))
    return rows.select(*groups, *[F.col(f"_r.{c}").alias(c) for c in rest])


def median_survival(curve: DataFrame, groups: Sequence[str]) -> DataFrame:
    """median, lower, upper: first time at or under one half, null when it stays above.

    A curve that rests exactly on one half has its median midway to the next event.
    """
    near = F.abs(F.col("surv") - 0.5) < 1e-9
    below = F.when((F.col("surv") < 0.5) & ~near, F.col("time"))
    first = lambda c: F.min(F.when(F.col(c) <= 0.5, F.col("time")))
    # a dead group has no limits; its lower limit crossed before
    agg = curve.groupBy(*groups).agg(
        F.min(F.when(near, F.col("time"))).alias("_rest"), F.min(below).alias("_below"),
        first("lower").alias("lower"), first("upper").alias("upper"))
    middle = F.when(F.col("_rest").isNull(), F.col("_below")).otherwise(
        (F.col("_rest") + F.coalesce("_below", "_rest")) / 2)
    return agg.select(*groups, middle.alias("median"), "lower", "upper")


# --- log-rank -------------------------------------------------------------------------

def _risk_grid(df: DataFrame, strata: Sequence[str], group: str, levels: Sequence, time: str, status: str,
               slices: int) -> DataFrame:
    """Per stratum and time: at-risk r_i and events d_i of each level side by side."""
    ok = F.col(time).isNotNull() & F.col(status).isNotNull() & F.col(group).isin(list(levels))
    aggs = []
    for i, level in enumerate(levels):
        mine = F.col(group) == F.lit(level)
        aggs.append(F.sum(mine.cast("int")).alias(f"n{i}"))
        aggs.append(F.sum((mine & (F.col(status) == 1)).cast("int")).alias(f"d{i}"))
    counts = df.filter(ok).groupBy(*strata, F.col(time).alias("time")).agg(*aggs)
    counts, slice_col = quantile_slices(counts, "time", slices)
    k = range(len(levels))
    grid = running(counts, strata, [F.col("time")], {f"u{i}": ("sum", f"n{i}") for i in k}, slice_col,
                   totals={f"t{i}": f"n{i}" for i in k})
    return _at_risk(grid, k)


def _at_risk(grid: DataFrame, levels: Iterable[int]) -> DataFrame:
    """r_i and d_i as doubles: products of counts overflow longs."""
    cols = {}
    for i in levels:
        cols[f"r{i}"] = (F.col(f"t{i}") - F.col(f"u{i}") + F.col(f"n{i}")).cast("double")
        cols[f"d{i}"] = F.col(f"d{i}").cast("double")
    return grid.withColumns(cols)


def _pair_terms(a: int, b: int) -> tuple[Column, Column]:
    """Observed minus expected of level a against b at one time, and its variance."""
    ra, rb, da, db = F.col(f"r{a}"), F.col(f"r{b}"), F.col(f"d{a}"), F.col(f"d{b}")
    r, d = ra + rb, da + db
    diff = F.when(r > 0, da - d * ra / r).otherwise(0.0)
    var = F.when(r > 1, d * (ra / r) * (rb / r) * (r - d) / (r - 1)).otherwise(0.0)
    return diff, var


@F.pandas_udf(T.DoubleType())
def _quadratic_form(diff: pd.Series, cov: pd.Series) -> pd.Series:
    out = []
    for u, v in zip(diff, cov):
        u = np.asarray(u, float)
        v = np.asarray(v, float).reshape(len(u), len(u))
        keep = np.diag(v) > 0
        u, v = u[keep][:-1], v[np.ix_(keep, keep)][:-1, :-1]
        out.append(float(u @ np.linalg.solve(v, u)) if len(u) else np.nan)
    return pd.Series(out)


def chisq1_pvalue(x: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom, as a native expression."""
    return F.exp(log_erfc(F.sqrt(x / 2)))


def logrank(df: DataFrame, group: str, levels: Sequence, strata: Sequence[str] = (), time: str = "time",
            status: str = "status", slices: int = BOUNDED) -> DataFrame:
    """Log-rank test of equal survival in the listed groups, one row per stratum."""
    k = len(levels)
    grid = _risk_grid(df, strata, group, levels, time, status, slices)
    r = sum((F.col(f"r{i}") for i in range(k)), F.lit(0))
    d = sum((F.col(f"d{i}") for i in range(k)), F.lit(0))
    grid = grid.withColumns({"_r": r, "_d": d}).filter("_d > 0")
    share = [F.col(f"r{i}") / F.col("_r") for i in range(k)]
    spread = F.when(F.col("_r") > 1, F.col("_d") * (F.col("_r") - F.col("_d")) / (F.col("_r") - 1)).otherwise(0.0)
    sums = [F.sum(F.col(f"d{i}") - F.col("_d") * share[i]).alias(f"u{i}") for i in range(k)]
    sums += [F.sum(F.col(f"d{i}")).cast("double").alias(f"o{i}") for i in range(k)]
    for i in range(k):
        for j in range(i, k):
            term = share[i] * ((1.0 if i == j else 0.0) - share[j])
            sums.append(F.sum(spread * term).alias(f"v{i}_{j}"))
    total = grid.groupBy(*strata).agg(*sums)
    v = lambda i, j: F.col(f"v{min(i, j)}_{max(i, j)}")
    if k == 2:
        chisq = F.col("u0") * F.col("u0") / F.when(v(0, 0) > 0, v(0, 0))
        tests = total.withColumn("chisq", chisq).withColumn("pval", chisq1_pvalue(F.col("chisq")))
        df_col = F.lit(1.0)
    else:
        cov = F.array(*[v(i, j) for i in range(k) for j in range(k)])
        df_col = sum((F.when(v(i, i) > 0, 1.0).otherwise(0.0) for i in range(k)), F.lit(0.0)) - 1
        tests = total.withColumn("chisq", _quadratic_form(F.array(*[F.col(f"u{i}") for i in range(k)]), cov))
        tests = tests.withColumn("pval", chisq_pvalue(F.col("chisq"), df_col))
    return tests.select(*strata, "chisq", df_col.alias("df"), "pval")


def logrank_pairwise(df: DataFrame, group: str, levels: Sequence, time: str = "time", status: str = "status",
                     slices: int = BOUNDED) -> DataFrame:
    """Every pair of groups: chisq, pval and the Benjamini-Hochberg adjusted p-value.

    All pairs are read off one grid of at-risk counts in a single aggregate.
    """
    k = len(levels)
    grid = _risk_grid(df, [], group, levels, time, status, slices)
    pairs = [(a, b) for a in range(k) for b in range(a + 1, k)]
    sums = []
    for a, b in pairs:
        diff, var = _pair_terms(a, b)
        sums += [F.sum(diff).alias(f"u{a}_{b}"), F.sum(var).alias(f"v{a}_{b}")]
    row = grid.agg(*sums)
    tests = row.select(F.inline(F.array(*[
        F.struct(
            F.lit(str(levels[a])).alias("group1"), F.lit(str(levels[b])).alias("group2"),
            (F.col(f"u{a}_{b}") * F.col(f"u{a}_{b}") / F.when(F.col(f"v{a}_{b}") > 0, F.col(f"v{a}_{b}"))).alias("chisq"))
        for a, b in pairs])))
    tests = tests.withColumn("pval", chisq1_pvalue(F.col("chisq")))
    return adjust_pvalues(tests)


def adjust_pvalues(tests: DataFrame, pval: str = "pval", keys: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg adjustment over a small table of tests."""
    groups = [F.col(k) for k in keys]
    rank = Window.partitionBy(*groups).orderBy(F.col(pval).asc_nulls_last())
    m = F.count(pval).over(Window.partitionBy(*groups))
    raw = F.least(F.col(pval) * m / F.max("_i").over(Window.partitionBy(*groups, F.col(pval))), F.lit(1.0))
    table = tests.withColumn("_i", F.row_number().over(rank)).withColumn("_raw", raw)
    up = Window.partitionBy(*groups).orderBy(F.col("_i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return table.withColumn("padj", F.when(F.col(pval).isNotNull(), F.min("_raw").over(up))).drop("_i", "_raw")


# --- competing risks ------------------------------------------------------------------

def cumulative_incidence(df: DataFrame, groups: Sequence[str], time: str = "time", status: str = "status",
                         slices: int = BOUNDED) -> DataFrame:
    """Incidence of event 1 with event 2 competing: est and var at each observed time.

    Variance by the three running sums of Gray (1988) with his tie correction; it changes at
    type-1 events only.
    """
    table, slice_col = life_table(df, groups, time, status, slices)
    n, d1, d2 = F.col("at_risk"), F.col("d1"), F.col("d2")
    d = d1 + d2
    steps = table.withColumns({
        "_log": F.when((d > 0) & (d < n), F.log1p(-d / n)).otherwise(0.0),
        "_end": (d == n).cast("int"),
    })
    order = [F.col("time")]
    surv = running(steps, groups, order, {"_l0": ("sum", "_log"), "_x0": ("max", "_end")}, slice_col, before=True)
    before = F.when(F.coalesce("_x0", F.lit(0)) == 1, 0.0).otherwise(F.exp("_l0"))
    surv = surv.withColumn("_s0", before).withColumn("_s1", F.col("_s0") * (n - d) / n)
    surv = surv.withColumn("_inc", F.col("_s0") * d1 / n)
    cif = running(surv, groups, order, {"est": ("sum", "_inc")}, slice_col)
    s0, s1, est = F.col("_s0"), F.col("_s1"), F.col("est")
    tie = lambda k: F.when(k > 1, 1 - (k - 1) / (n - 1)).otherwise(1.0)
    inv = F.when(s1 > 0, 1 / s1).otherwise(0.0)
    w1 = F.when(d1 > 0, s0 * s0 * tie(d1) * d1 / (n * n)).otherwise(0.0)
    w2 = F.when((d2 > 0) & (s1 > 0), s0 * s0 * tie(d2) * d2 / (n * n)).otherwise(0.0)
    own, other = 1 + inv * est, inv * est
    terms = cif.withColumns({
        "_a": own * own * w1 + other * other * w2,
        "_b": inv * own * w1 + inv * other * w2,
        "_c": inv * inv * (w1 + w2),
    })
    sums = running(terms, groups, order, {"_v1": ("sum", "_a"), "_v2": ("sum", "_b"), "_v3": ("sum", "_c")}, slice_col)
    var = F.col("_v1") + est * est * F.col("_v3") - 2 * est * F.col("_v2")
    return sums.select(*groups, "time", "at_risk", "d1", "d2", "est", F.greatest(var, F.lit(0.0)).alias("var"))


def incidence_at(curve: DataFrame, groups: Sequence[str], horizon: float) -> DataFrame:
    """Estimate, std, log(-log) limits just before the first step at or after the horizon.

    Groups not observed to the horizon have no row.
    """
    step = F.when((F.col("time") < horizon) & (F.col("d1") > 0), F.struct("time", "est", "var"))
    rows = curve.groupBy(*groups).agg(F.max(step).alias("_r"), F.max("time").alias("_last"))
    rows = rows.filter(F.col("_last") >= horizon)
    est, var = F.coalesce("_r.est", F.lit(0.0)), F.coalesce("_r.var", F.lit(0.0))
    inside = (est > 0) & (est < 1)
    shift = F.lit(Z95) * F.sqrt(var) / F.when(inside, est * F.log(est))
    return rows.select(
        *groups, est.alias("est"), F.sqrt(var).alias("std"),
        F.when(inside, F.pow(est, F.exp(-shift))).alias("lower"), F.when(inside, F.pow(est, F.exp(shift))).alias("upper"))


# --- survival by genotype -------------------------------------------------------------

def hard_call(dosage: Column) -> Column:
    return F.when(dosage < 0.5, 0).when(dosage < 1.5, 1).when(dosage.isNotNull(), 2)


def by_genotype(dosages: DataFrame, follow_up: DataFrame, at: float = 85.0, slices: int = BOUNDED) -> DataFrame:
    """Per marker and genotype: median survival, survival at a time, log-rank p-value.

    ``follow_up`` has id, time, status and may repeat an id. The rarest genotype is left out
    when three occur (the lowest of equally rare ones).
    """
    rows = dosages.filter("dosage IS NOT NULL").select("marker_id", "id", hard_call(F.col("dosage")).alias("geno"))
    counted = rows.join(follow_up.select("id", "time", "status").filter("time IS NOT NULL"), "id").groupBy(
        "marker_id", "geno", "time").agg(F.count(F.lit(1)).alias("k"), F.sum("status").alias("events"))
    sizes = counted.groupBy("marker_id", "geno").agg(F.sum("k").alias("size"))
    rare = sizes.groupBy("marker_id").agg(F.count(F.lit(1)).alias("_classes"), F.min(F.struct("size", "geno")).alias("_min"))
    rare = rare.filter("_classes > 2").select("marker_id", F.col("_min.geno").alias("geno"))
    kept = counted.join(rare, ["marker_id", "geno"], "left_anti")
    people = kept.select("marker_id", "geno", "time", F.inline(F.array(
        F.struct(F.lit(1).alias("status"), F.col("events").alias("w")),
        F.struct(F.lit(0).alias("status"), (F.col("k") - F.col("events")).alias("w"))))).filter("w > 0")
    groups = ["marker_id", "geno"]
    table, slice_col = life_table(people, groups, slices=slices, weight=F.col("w"))
    curve = _curve(table, groups, slice_col)
    summary = median_survival(curve, groups)
    keep = [*groups, "surv", "lower", "upper"]
    there = curve.filter(F.col("time") == at).select(*keep).toDF(*groups, "surv_at", "lower_at", "upper_at")
    # two classes are left: the test of the lower one against the other
    low = people.withColumn("_lowest", F.min("geno").over(Window.partitionBy("marker_id")))
    side = F.when(F.col("geno") == F.col("_lowest"), 0).otherwise(1)
    grid = low.groupBy("marker_id", "time").agg(*[
        F.sum(F.when(c, F.col("w")).otherwise(0)).alias(a)
        for a, c in (("n0", side == 0), ("n1", side == 1),
                     ("d0", (side == 0) & (F.col("status") == 1)), ("d1", (side == 1) & (F.col("status") == 1)))])
    grid, slice_col = quantile_slices(grid, "time", slices)
    grid = running(grid, ["marker_id"], [F.col("time")], {"u0": ("sum", "n0"), "u1": ("sum", "n1")}, slice_col,
                   totals={"t0": "n0", "t1": "n1"})
    grid = _at_risk(grid, (0, 1))
    diff, var = _pair_terms(0, 1)
    test = grid.groupBy("marker_id").agg(F.sum(diff).alias("u"), F.sum(var).alias("v"))
    chisq = F.col("u") * F.col("u") / F.when(F.col("v") > 0, F.col("v"))
    test = test.select("marker_id", chisq1_pvalue(chisq).alias("pval"))
    return natural_join(natural_join(summary, there), test)
