"""Crossed mixed models against the likelihood itself, and planted variances on many rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators import mixed


def likelihood(y, x, groups, variances, restricted):
    """Log-likelihood, coefficients and their standard errors from the whole covariance matrix."""
    v = variances[-1] * np.eye(len(y))
    for g, s in zip(groups, variances, strict=False):
        z = (g[:, None] == np.unique(g)[None, :]).astype(float)
        v += s * z @ z.T
    w = np.linalg.inv(v)
    info = x.T @ w @ x
    beta = np.linalg.solve(info, x.T @ w @ y)
    r = y - x @ beta
    free = len(y) - (x.shape[1] if restricted else 0)
    log = np.linalg.slogdet(v)[1] + r @ w @ r + free * np.log(2 * np.pi) + (np.linalg.slogdet(info)[1] if restricted else 0)
    return -log / 2, beta, np.sqrt(np.diag(np.linalg.inv(info)))


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(0)
    n = 700
    a, b, x = rng.integers(0, 12, n), rng.integers(0, 9, n), rng.normal(size=n)
    y = 1 + 0.7 * x + rng.normal(size=12)[a] * 0.8 + rng.normal(size=9)[b] * 0.5 + rng.normal(size=n) * 0.6
    rows = [(float(p), float(q), int(r), int(s)) for p, q, r, s in zip(y, x, a, b, strict=True)]
    rows += [(None, 1.0, 0, 0), (1.0, None, 0, 0), (1.0, 1.0, None, 0), (float("nan"), 1.0, 1, 1)]  # these don't count
    return spark.createDataFrame(rows, "y double, x double, a int, b int"), y, np.stack([np.ones(n), x], 1), (a, b)


def design():
    return {"one": F.lit(1.0), "x": F.col("x")}


@pytest.mark.parametrize("method", ["ml", "reml"])
def test_crossed_is_at_the_maximum(small, method):
    df, y, x, groups = small
    fit = mixed.crossed(df, "y", design(), ["a", "b"], method)
    best, beta, se = likelihood(y, x, groups, [*fit.variances, fit.residual], method == "reml")
    assert fit.converged and fit.n == len(y)
    assert np.allclose(fit.beta, beta, atol=1e-8) and np.allclose(fit.se, se, rtol=1e-6) and abs(fit.loglike - best) < 1e-6
    for i in range(3):
        for e in (0.98, 1.02):
            off = np.array([*fit.variances, fit.residual])
            off[i] *= e
            assert likelihood(y, x, groups, off, method == "reml")[0] < best
    got = {(r["grouping"], r["level"]): r for r in fit.effects.collect()}
    assert len(got) == 21 and got["a", "3"]["n"] == int((groups[0] == 3).sum())
    # the best predictor of a level, from the whole covariance matrix
    v = fit.residual * np.eye(len(y)) + sum(s * (g[:, None] == g[None, :]) for g, s in zip(groups, fit.variances, strict=True))
    want = fit.variances[0] * (groups[0] == 3) @ np.linalg.solve(v, y - x @ beta)
    assert abs(got["a", "3"]["effect"] - want) < 1e-6


def test_one_grouping_and_dependent_columns(small):
    """A redundant fixed column changes neither variances nor likelihood."""
    df, y, x, groups = small
    plain = mixed.crossed(df, "y", design(), ["a"])
    double = mixed.crossed(df, "y", {**design(), "again": F.col("x") * 2.0}, ["a"])
    assert np.allclose(plain.variances, double.variances, rtol=1e-5) and abs(plain.loglike - double.loglike) < 1e-6
    assert abs(plain.loglike - likelihood(y, x, groups[:1], [*plain.variances, plain.residual], False)[0]) < 1e-6


def test_no_variance_stays_at_the_floor(spark):
    rng = np.random.default_rng(1)
    rows = [(float(rng.normal()), int(k % 10), int(k // 10 % 7)) for k in range(900)]
    df = spark.createDataFrame(rows, "y double, a int, b int")
    df = df.join(df.groupBy("a").agg(F.avg("y").alias("m")), "a").withColumn("y", F.col("y") - F.col("m"))  # level means are all 0
    fit = mixed.crossed(df, "y", {"one": F.lit(1.0)}, ["a"])
    assert fit.variances[0] < 1e-3 * fit.residual


def test_equations_solved_by_iteration_agree(small):
    df, *_ = small
    exact, far = (mixed.Equations(df, F.col("y"), list(design().values()), ["a", "b"], d) for d in (512, 0))
    ratios = np.array([0.7, 1.9])
    want = exact.solve(exact.right_side(), ratios, np.array([True]))
    got = far.solve(far.right_side(), ratios, np.array([True]), tolerance=1e-10)
    assert np.allclose(got.fixed, want.fixed, atol=1e-7)
    table = {(r["g"], r["level"]): r["v"][0] for r in got.table.collect()}
    assert np.allclose([table[k] for k in exact.order], want.dense[:, 0], atol=1e-7)


def test_planted_variances_of_a_million_rows(spark):
    """Iterated solutions, estimated traces: variances of 60 and 900 levels, of unequal size, come back."""
    normal = lambda seed, *by: (lambda u, v: F.sqrt(-2 * F.log(u)) * F.cos(v * 2 * np.pi))(*[(F.pmod(F.xxhash64(F.lit(seed + i), *by), F.lit(1 << 30)) + 0.5) / float(1 << 30) for i in (0, 1)])
    df = spark.range(1_000_000).select("id", (F.sqrt(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(3600)))).cast("int").alias("a"), F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(900)).alias("b"))
    df = df.withColumn("x", normal(10, "id")).withColumn("y", 2 - 0.5 * F.col("x") + 0.9 * normal(20, "a") + 0.4 * normal(30, "b") + normal(40, "id"))
    fit = mixed.crossed(df, "y", design(), ["a", "b"], "reml", direct=0, tolerance=1e-3)
    of = lambda c, seed, size: df.select(c, normal(seed, c).alias("u")).distinct().agg(F.var_samp("u")).first()[0] * size**2
    assert fit.converged and abs(fit.residual - 1) < 0.01 and abs(fit.beta[1] + 0.5) < 0.01
    assert abs(fit.variances[0] / of("a", 20, 0.9) - 1) < 0.03 and abs(fit.variances[1] / of("b", 30, 0.4) - 1) < 0.03
