"""Least squares from sums: one aggregate over the rows, a k-by-k solve on the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, columns: Sequence[Column]) -> np.ndarray:
    """Matrix of sums of products of the columns (k*k numbers reach the driver)."""
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(*[F.sum(columns[i] * columns[j]).alias(f"s{i}_{j}") for i, j in pairs]).first()
    m = np.zeros((k, k))
    for i, j in pairs:
        value = row[f"s{i}_{j}"]
        m[i, j] = m[j, i] = 0.0 if value is None else float(value)
    return m


def combine(columns: Sequence[Column], weights: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for c, w in zip(columns, weights):
        total = total + c * F.lit(float(w))
    return total


def ols_coefficients(df: DataFrame, design: Sequence[Column], target: Column) -> np.ndarray:
    """Coefficients of target on the design columns (least norm when they are collinear)."""
    m = gram(df, [*design, target])
    k = len(design)
    return np.linalg.lstsq(m[:k, :k], m[:k, k], rcond=None)[0]


def orthonormal(df: DataFrame, design: Sequence[Column]) -> list[Column]:
    """Column expressions that span the design and have unit sums of squares.

    Collinear design columns are dropped. Columns are scaled before the factorisation.
    """
    m = gram(df, design)
    keep = [i for i in range(len(design)) if m[i, i] > 0]
    scale = 1.0 / np.sqrt(np.diag(m)[keep])
    values, vectors = np.linalg.eigh(m[np.ix_(keep, keep)] * np.outer(scale, scale))
    out = []
    for value, vector in zip(values, vectors.T):
        if value > 1e-10:
            out.append(combine([design[i] for i in keep], vector * scale / np.sqrt(value)))
    return out
