"""The monitor's size grid against every cell computed by itself."""

from __future__ import annotations

import hashlib

import numpy as np

from driftloom.operators import monitor_grid


def plain_cell(batch, hits, reference):
    sq = lambda a, b: ((a[:, None] - b[None]) ** 2).sum(-1)
    pool = np.concatenate([batch, reference])
    far = sq(pool, pool)[np.triu_indices(len(pool), 1)]
    gamma = 1 / (2 * np.median(far[far > 1e-12]))
    near = np.sort(1 - batch @ reference.T, axis=1)[:, : min(5, len(reference))]
    a, b = batch.mean(0), reference.mean(0)
    k = lambda x, y: np.exp(-gamma * sq(x, y)).mean()
    return hits.mean(), near[:, 0].mean(), near.mean(), 1 - a @ b / ((np.linalg.norm(a) + 1e-8) * (np.linalg.norm(b) + 1e-8)), max(k(batch, batch) + k(reference, reference) - 2 * k(batch, reference), 0)


def test_every_cell_of_the_grid(spark):
    """Any dimension, sizes beyond the rows, a condition of one row (left out)."""
    rng = np.random.default_rng(0)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 24)))
    sides = {"bank": unit(60), "t1": unit(40), "t2": unit(9), "one": unit(1)}
    hits = {k: rng.integers(0, 2, len(v)) for k, v in sides.items()}
    bank = spark.createDataFrame([("d", i, v.tolist()) for i, v in enumerate(sides["bank"])], "k string, vec_id long, u array<double>")
    rows = [("d", t, i, v.tolist(), int(hits[t][i])) for t in ("t1", "t2", "one") for i, v in enumerate(sides[t])]
    shifted = spark.createDataFrame(rows, "k string, tag string, vec_id long, u array<double>, hit int")
    got = {(r["tag"], r["repeat"], r["batch_size"], r["reference_size"]): r for r in monitor_grid.size_grid(shifted, bank, ["k"], batches=(2, 8, 64), references=(3, 50, 1000), repeats=2).collect()}
    assert len(got) == 2 * 2 * 9
    order = lambda n, *salt: sorted(range(n), key=lambda i: hashlib.md5("|".join([*map(str, salt), str(i)]).encode()).hexdigest())
    for (tag, rep, n, m), r in got.items():
        b, c = order(len(sides[tag]), "grid", rep, tag)[:n], order(60, "grid", rep)[:m]
        want = plain_cell(sides[tag][b], hits[tag][b], sides["bank"][c])
        assert (r["n_batch"], r["n_ref"]) == (len(b), len(c))
        assert np.allclose([r["acc_batch"], *[r[s] for s in monitor_grid.SCORES[:4]]], want, atol=1e-9)
        if (n, m) == (64, 1000):
            assert abs(r["ref_mmd_shared"] - r["ref_mmd_rbf"]) < 1e-9  # the shared bandwidth is that of the largest cell
    assert monitor_grid.size_grid(shifted.filter("false"), bank, ["k"]).count() == 0


def test_discrepancy_over_whole_batches_and_references(spark):
    """Kernels and bandwidths took the first 512 rows of a side only, so that larger cells had the discrepancy of smaller ones."""
    rng = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    reference, batch = unit(rng.normal(size=(700, 8))), unit(rng.normal(size=(600, 8)) + 0.4)
    reference[512:] = unit(reference[512:] + 2)  # rows beyond the first 512 are unlike those before them
    hits = rng.integers(0, 2, 600).astype(float)
    found = {(c[0], c[1]): c for c in monitor_grid.cells(batch, hits, reference, (20, 600), (300, 1000))}
    for (n, m), c in found.items():
        assert np.allclose([c[4], *c[5:9]], plain_cell(batch[:n], hits[:n], reference[:m]), atol=1e-9), (n, m)
    pool = np.concatenate([batch, reference])
    far = ((pool[:, None] - pool[None]) ** 2).sum(-1)[np.triu_indices(len(pool), 1)]
    gamma = 1 / (2 * np.median(far))
    k = lambda x, y: np.exp(-gamma * ((x[:, None] - y[None]) ** 2).sum(-1)).mean()
    for (n, m), c in found.items():
        a, b = batch[:n], reference[:m]
        assert abs(c[9] - max(k(a, a) + k(b, b) - 2 * k(a, b), 0)) < 1e-9, (n, m)


def test_grid_of_a_bank_of_more_than_512_rows(spark):
    """The two cells of ``l10_grid_cells``: the larger one's discrepancy came from 512 rows of its reference, SQL's from all."""
    rng = np.random.default_rng(2)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 16)))
    x, moved, hits = unit(640), unit(90), rng.integers(0, 2, 90)
    bank = spark.createDataFrame([("d", i, v.tolist()) for i, v in enumerate(x)], "k string, vec_id long, u array<double>")
    shifted = spark.createDataFrame([("d", "t", i, v.tolist(), int(hits[i])) for i, v in enumerate(moved)], "k string, tag string, vec_id long, u array<double>, hit int")
    got = monitor_grid.size_grid(shifted, bank, ["k"], batches=(8, 64), references=(100, 1000), repeats=2).collect()
    assert sorted({(r["n_batch"], r["n_ref"]) for r in got}) == [(8, 100), (8, 640), (64, 100), (64, 640)] and len(got) == 8
    order = lambda n, *salt: sorted(range(n), key=lambda i: hashlib.md5("|".join([*map(str, salt), str(i)]).encode()).hexdigest())
    for r in got:
        b, c = order(90, "grid", r["repeat"], "t")[: r["n_batch"]], order(640, "grid", r["repeat"])[: r["n_ref"]]
        assert np.allclose([r["acc_batch"], *[r[s] for s in monitor_grid.SCORES[:4]]], plain_cell(moved[b], hits[b], x[c]), atol=1e-9)
