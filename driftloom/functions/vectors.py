"""Vector expressions over array<double> columns; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column, size: int | None = None) -> Column:
    """Inner product; with a known ``size`` a flat sum that is compiled, else a fold."""
    if size:
        return reduce(lambda x, y: x + y, [a[i] * b[i] for i in range(size)])
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column, eps: float = 1e-12) -> Column:
    """v / max(norm, eps); the norm is bound first, so that it is computed once and not for each component."""
    size = F.array(F.greatest(norm(v), F.lit(eps)))
    return F.transform(size, lambda n: F.transform(v, lambda x: x / n))[0]


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def mean_vector(v: Column, size: int) -> Column:
    """Componentwise average as an aggregate: partial sums are combined before the shuffle."""
    return F.array(*[F.avg(v[i]) for i in range(size)])


def sum_vector(v: Column, size: int) -> Column:
    return F.array(*[F.sum(v[i]) for i in range(size)])


def sq_dist(a: Column, b: Column, size: int) -> Column:
    """Squared distance, never below 0."""
    return F.greatest(reduce(lambda x, y: x + y, [(a[i] - b[i]) * (a[i] - b[i]) for i in range(size)]), F.lit(0.0))
