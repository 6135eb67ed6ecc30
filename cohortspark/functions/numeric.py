"""Numeric column functions: bucketing, interpolation, normal quantile and tail areas.

Everything except the t and chi-square tails is a plain Column expression and stays in
generated code. Those two run as Arrow batches over tables that hold one row per test.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: Wichura (1988), algorithm AS 241, normal quantile ------------------
AS241_CENTRE_NUM = (
    3.3871328727963666080, 1.3314166789178437745e2, 1.9715909503065514427e3,
    1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
    3.3430575583588128105e4, 2.5090809287301226727e3,
)
AS241_CENTRE_DEN = (
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
    5.2264952788528545610e3,
)
AS241_MIDDLE_NUM = (
    1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550,
    3.64784832476320460504, 1.27045825245236838258, 2.41780725177450611770e-1,
    2.27238449892691845833e-2, 7.74545014278341407640e-4,
)
AS241_MIDDLE_DEN = (
    1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
    1.05075007164441684324e-9,
)
AS241_FAR_NUM = (
    6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580,
    2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
    2.71155556874348757815e-5, 2.01033439929228813265e-7,
)
AS241_FAR_DEN = (
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
    2.04426310338993978564e-15,
)
# --- fixed values: Cody (1969), rational approximations of erf and erfc ---------------
CODY_ERF_NUM = (
    3.20937758913846947e03, 3.77485237685302021e02, 1.13864154151050156e02,
    3.16112374387056560e00, 1.85777706184603153e-1,
)
CODY_ERF_DEN = (
    2.84423683343917062e03, 1.28261652607737228e03, 2.44024637934444173e02,
    2.36012909523441209e01, 1.0,
)
CODY_MID_NUM = (
    1.23033935479799725e03, 2.05107837782607147e03, 1.71204761263407058e03,
    8.81952221241769090e02, 2.98635138197400131e02, 6.61191906371416295e01,
    8.88314979438837594e00, 5.64188496988670089e-1, 2.15311535474403846e-8,
)
CODY_MID_DEN = (
    1.23033935480374942e03, 3.43936767414372164e03, 4.36261909014324716e03,
    3.29079923573345963e03, 1.62138957456669019e03, 5.37181101862009858e02,
    1.17693950891312499e02, 1.57449261107098347e01, 1.0,
)
CODY_FAR_NUM = (
    6.58749161529837803e-4, 1.60837851487422766e-2, 1.25781726111229246e-1,
    3.60344899949804439e-1, 3.05326634961232344e-1, 1.63153871373020978e-2,
)
CODY_FAR_DEN = (
    2.33520497626869185e-3, 6.05183413124413191e-2, 5.27905102951428412e-1,
    1.87295284992346725e00, 2.56852019228982242e00, 1.0,
)


def polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """Horner form, coefficients from the constant upwards."""
    return reduce(lambda acc, c: acc * x + F.lit(c), reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def _qnorm_tail(p: Column) -> Column:
    return F.sqrt(-F.log(F.when(p < 0.5, p).otherwise(F.lit(1.0) - p)))


def _qnorm_from(p: Column, tail: Column) -> Column:
    q = p - F.lit(0.5)
    r0 = F.lit(0.180625) - q * q
    centre = q * polynomial(r0, AS241_CENTRE_NUM) / polynomial(r0, AS241_CENTRE_DEN)
    rm, rf = tail - F.lit(1.6), tail - F.lit(5.0)
    size = F.when(
        tail <= 5, polynomial(rm, AS241_MIDDLE_NUM) / polynomial(rm, AS241_MIDDLE_DEN)
    ).otherwise(polynomial(rf, AS241_FAR_NUM) / polynomial(rf, AS241_FAR_DEN))
    value = F.when(F.abs(q) <= 0.425, centre).when(q < 0, -size).otherwise(size)
    return F.when((p > 0) & (p < 1), value)


def qnorm(p: Column) -> Column:
    """Standard normal quantile; null outside (0, 1)."""
    return _qnorm_from(p, _qnorm_tail(p))


def with_qnorm(df: DataFrame, p: str, output: str) -> DataFrame:
    """Replace a probability column by its normal quantile.

    In two projections, so that the polynomials refer to columns and the plan stays small.
    """
    out = df.withColumn("_tail", _qnorm_tail(F.col(p))).withColumn(output, _qnorm_from(F.col(p), F.col("_tail")))
    return out.drop("_tail", *([p] if p != output else []))


def log_erfc(x: Column) -> Column:
    """Natural log of erfc for x >= 0, finite far beyond where erfc underflows."""
    y = x * x
    near = F.log(F.lit(1.0) - x * polynomial(y, CODY_ERF_NUM) / polynomial(y, CODY_ERF_DEN))
    mid = -y + F.log(polynomial(x, CODY_MID_NUM) / polynomial(x, CODY_MID_DEN))
    inv = F.lit(1.0) / y
    frac = inv * polynomial(inv, CODY_FAR_NUM) / polynomial(inv, CODY_FAR_DEN)
    far = -y + F.log((F.lit(1.0 / math.sqrt(math.pi)) - frac) / x)
    return F.when(x <= 0.46875, near).when(x <= 4, mid).otherwise(far)


def log10_normal_two_sided(z: Column) -> Column:
    """log10 of the two-sided normal p-value."""
    return log_erfc(F.abs(z) / F.lit(math.sqrt(2.0))) / F.lit(math.log(10.0))


def log10_pvalue(p: Column, floor: float = -400.0) -> Column:
    """log10 with the stated value for a p-value that was written as zero."""
    return F.when(p == 0, F.lit(floor)).otherwise(F.log10(p))


def bucketize(x: Column, breaks: Sequence[float], include_lowest: bool = False) -> Column:
    """1-based index of the half-open interval [b_i, b_i+1) that holds x, else null.

    With ``include_lowest`` the last interval is closed.
    """
    edges = [float(b) for b in breaks]
    index = F.when(F.lit(False), F.lit(0))
    for i, (lo, hi) in enumerate(zip(edges, edges[1:]), start=1):
        last = include_lowest and i == len(edges) - 1
        index = index.when((x >= lo) & ((x <= hi) if last else (x < hi)), F.lit(i))
    return index


def interval_label(index: Column, breaks: Sequence[float], include_lowest: bool = False) -> Column:
    """Text form of a bucket, e.g. ``[35,40)``."""
    text = [f"{b:g}" for b in breaks]
    labels = [f"[{a},{b})" for a, b in zip(text, text[1:])]
    if include_lowest and labels:
        labels[-1] = labels[-1][:-1] + "]"
    # guarded: element_at with a null index is not null-safe in every Spark build
    return F.when(index.isNotNull(), F.element_at(F.array(*[F.lit(s) for s in labels]), F.coalesce(index, F.lit(1))))


def interpolate(x: Column, knots: Column) -> Column:
    """Piecewise-linear lookup in a sorted ARRAY<STRUCT<x, y>>; null outside its range."""
    left = F.filter(knots, lambda k: k["x"] <= x)
    n = F.size(left)
    a = F.element_at(knots, F.greatest(n, F.lit(1)))
    b = F.try_element_at(knots, n + 1)
    span = F.nullif(b["x"] - a["x"], F.lit(0.0))
    line = a["y"] + (b["y"] - a["y"]) * (x - a["x"]) / span
    return F.when(x.isNull() | (n == 0), F.lit(None)).when(b.isNull(), F.when(x == a["x"], a["y"])).otherwise(line)


def level_code(x: Column, levels: Sequence[str]) -> Column:
    """1-based position of a value in its ordered level list, null when absent."""
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), x)
    return F.nullif(position, F.lit(0)).cast("int")


# --- tails on already aggregated tables -----------------------------------------------

def _log_beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Log of the regularised incomplete beta I_x(a, b) by Lentz's continued fraction."""
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    front = lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x) - np.log(a)
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + term / np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return front + np.log(h)


def log10_t_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """log10 two-sided p-value of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & (df > 0)
    tt, nu = t[ok] ** 2, df[ok]
    x = nu / (nu + tt)
    a, b = nu / 2.0, np.full_like(nu, 0.5)
    small = x < (a + 1.0) / (a + b + 2.0)
    value = np.zeros_like(x)
    if small.any():
        value[small] = _log_beta_fraction(a[small], b[small], x[small])
    rest = ~small & (tt > 0)
    if rest.any():
        y = tt[rest] / (nu[rest] + tt[rest])
        value[rest] = np.log1p(-np.exp(_log_beta_fraction(b[rest], a[rest], y)))
    out[ok] = value / math.log(10.0)
    return out


def chisq_tail(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Upper tail of chi-square: series below the mean, continued fraction above it."""
    out = np.full(np.shape(x), np.nan)
    for i, (v, k) in enumerate(zip(np.asarray(x, float), np.asarray(df, float))):
        if not (np.isfinite(v) and k > 0):
            continue
        a, z = k / 2.0, max(v, 0.0) / 2.0
        if z == 0:
            out[i] = 1.0
            continue
        scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
        if z < a + 1:
            term = total = 1.0 / a
            n = a
            while abs(term) > abs(total) * 1e-16:
                n += 1
                term *= z / n
                total += term
            out[i] = 1.0 - total * scale
        else:
            b, c = z + 1 - a, 1e300
            d = h = 1.0 / b
            for j in range(1, 500):
                an = -j * (j - a)
                b += 2
                d = 1.0 / (an * d + b)
                c = b + an / c
                h *= d * c
                if abs(d * c - 1) < 1e-16:
                    break
            out[i] = scale * h
    return out


@F.pandas_udf(T.DoubleType())
def t_log10_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(log10_t_tail(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def chisq_pvalue(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chisq_tail(x.to_numpy(float), df.to_numpy(float)))
