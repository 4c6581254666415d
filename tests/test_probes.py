"""Linear heads against fits in NumPy."""

from __future__ import annotations

import numpy as np
import pytest

from driftloom.operators import probes


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    out, rows = {}, []
    for g, (n, c, d) in {"a": (400, 5, 7), "b": (300, 3, 7), "one": (40, 1, 7)}.items():
        centre = rng.normal(size=(c, d))
        y = rng.integers(0, c, n)
        x = centre[y] * 0.7 + rng.normal(size=(n, d)) * np.arange(1, d + 1) + 3
        x[:, 2] = 1.5  # a constant feature
        out[g] = (x, y * 10)
        rows += [(g, int(b * 10), a.tolist()) for a, b in zip(x, y, strict=True)]
    rows += [(None, 1, [0.0] * 7), ("a", None, [0.0] * 7), ("a", 1, None)]
    return out, spark.createDataFrame(rows, "grp string, label long, u array<double>").repartition(5)


def standard(x):
    std = x.std(0)
    return np.concatenate([np.ones((len(x), 1)), (x - x.mean(0)) / np.where(std > 1e-12, std, 1)], axis=1)


def test_ridge_equals_normal_equations(data):
    out, df = data
    heads = probes.ridge(df, 2.0)
    for g, (x, y) in out.items():
        z, known = standard(x), np.unique(y)
        t = np.where(y[:, None] == known, 1.0, -1.0)
        w = np.linalg.solve(z.T @ z + 2.0 * np.diag([0.0] + [1.0] * 7), z.T @ t)
        assert np.allclose(heads[g].weights[:, 0] + x @ heads[g].weights[:, 1:].T, z @ w, atol=1e-8)


def test_logistic_is_at_the_minimum(data):
    """The likelihood's own Newton steps in NumPy come to the same weights, within 1e-6."""
    out, df = data
    heads = probes.logistic(df, 1.0, 1e-7)
    for g, (x, y) in out.items():
        z, known = standard(x), np.unique(y)
        c, d = len(known), z.shape[1]
        t, pen, w = (y[:, None] == known).astype(float), np.tile([0.0] + [1.0] * (d - 1), c), np.zeros(c * d)
        for _ in range(50):
            s = z @ w.reshape(c, d).T
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            grad = ((p - t).T @ z).ravel() + pen * w
            hess = np.diag(pen) + np.einsum("nij,nk,nl->ikjl", (p[:, :, None] * np.eye(c) - p[:, :, None] * p[:, None, :]), z, z).reshape(c * d, c * d)
            w = w - np.linalg.pinv(hess) @ grad
        h = heads[g]
        assert h.converged and h.passes < 100
        mine, best = h.weights[:, 0] + x @ h.weights[:, 1:].T, z @ w.reshape(c, d).T
        assert np.allclose(mine - mine.mean(1, keepdims=True), best - best.mean(1, keepdims=True), atol=1e-6)  # a common constant is free


def test_predictions(spark, data):
    out, df = data
    heads = probes.logistic(df.filter("grp = 'a'"), 1.0, 1e-6)
    got = probes.predicted(df.filter("u IS NOT NULL AND grp IS NOT NULL"), heads).collect()
    assert all((r["predicted"] is None) == (r["grp"] != "a") for r in got)
    h, right = heads["a"], [r["predicted"] == r["label"] for r in got if r["grp"] == "a" and r["label"] is not None]
    x, y = out["a"]
    assert abs(np.mean(right) - np.mean(h.classes[(h.weights[:, 0] + x @ h.weights[:, 1:].T).argmax(1)] == y)) < 0.01
    assert probes.logistic(df.filter("false")) == {} and probes.ridge(df.filter("false")) == {}


def test_rows_of_many_groups_are_held_once(spark, data):
    """Rows were repeated for each head that they train or test: the same heads and predictions from lists of groups."""
    out, df = data
    (x, y), (v, w) = out["a"], out["b"]
    rows = [(["a", "both"], int(c), r.tolist()) for c, r in zip(y, x, strict=True)] + [(["both", None], int(c), r.tolist()) for c, r in zip(w, v, strict=True)] + [([], 0, x[0].tolist()), (None, 0, x[0].tolist())]
    lists = spark.createDataFrame(rows, "grp array<string>, label long, u array<double>").repartition(3)
    packed, classes, d = probes._prepared(lists)
    assert d == 7 and set(classes) == {"a", "both"} and packed.selectExpr("sum(length(labels)) / 8").first()[0] == 700
    for fit in (probes.ridge, probes.logistic):
        alone, many = fit(df.filter("grp = 'a'")), fit(lists)
        assert np.allclose(alone["a"].weights, many["a"].weights, atol=1e-6) and set(many) == {"a", "both"}
    got = probes.predicted(spark.createDataFrame([(["both", "none", "a"], x[0].tolist()), ([], x[1].tolist()), (["a"], x[2].tolist())], "grp array<string>, u array<double>"), many).collect()
    of = lambda g, i: int(many[g].classes[(many[g].weights[:, 0] + x[i] @ many[g].weights[:, 1:].T).argmax()])
    assert [r["predicted"] for r in got] == [[of("both", 0), None, of("a", 0)], [], [of("a", 2)]]
