"""Least squares from sums of products: one aggregate over the rows, then a small system of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def levels(rows: DataFrame, names: Sequence[str]) -> dict[str, list[str]]:
    """The sorted levels of categorical columns; they are few, as conditions of an experiment are."""
    sets = rows.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in names]).first()
    return {c: list(sets[c]) for c in names}


def dummies(factors: dict[str, list[str]]) -> list[Column]:
    """An intercept, and for each factor a 0/1 column for every level but the first."""
    out = [F.lit(1.0)]
    for name, values in factors.items():
        out += [(F.col(name) == v).cast("double") for v in values[1:]]
    return out


def products(rows: DataFrame, columns: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """keys, n, xx: the flat matrix of sums of products of ``columns``; partial sums are combined before the shuffle."""
    k = len(columns)
    named = rows.select(*keys, F.array(*[c.cast("double") for c in columns]).alias("v"))
    sums = [F.sum(F.col("v")[i] * F.col("v")[j]) for i in range(k) for j in range(i, k)]
    return named.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("xx"))


def unpack(flat: Sequence[float], k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = flat
    return out + out.T - np.diag(np.diag(out))


def solve(xx: np.ndarray, y: int) -> tuple[np.ndarray, float, np.ndarray, int]:
    """Coefficients for column ``y`` on the columns before it, residual sum of squares, pseudo-inverse and rank."""
    a, b = xx[:y, :y], xx[:y, y]
    inverse = np.linalg.pinv(a, hermitian=True, rcond=1e-10)
    beta = inverse @ b
    return beta, float(xx[y, y] - b @ beta), inverse, int(np.linalg.matrix_rank(a, tol=1e-8 * max(np.abs(a).max(), 1), hermitian=True))


def residual_products(xx: np.ndarray, k: int) -> np.ndarray:
    """Sums of products of the columns from ``k`` on, after their regression on the first ``k``."""
    a, b = xx[:k, :k], xx[:k, k:]
    return xx[k:, k:] - b.T @ np.linalg.pinv(a, hermitian=True, rcond=1e-10) @ b


def arrow_rows(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)
