"""The library without the llm subpackage: contract, SQL oracles, invariants and hand-sized cases."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom import registry
from driftloom.functions import tails
from driftloom.operators.detectors import kernel_terms, ledoit_wolf, median_gamma
from driftloom.operators.neighbours import nearest
from driftloom.plans.base import neighbour_lists, records
from driftloom.plans.maps import components
from driftloom.plans.metrics import auc, best_f1

ORACLE = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return norm(float(v)) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_its_sql(spark, sf, db, name):
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = Counter(repr(tuple(norm(x) for x in r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    res = db.sql(registry.oracle_sql()[name])
    at = [res.columns.index(c) for c in cols]
    assert sorted(res.columns) == cols
    assert got == Counter(repr(tuple(norm(r[i]) for i in at)) for r in res.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLE)))
def test_query_without_sql_runs(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    assert df.columns and df.count() > 0


def test_entry_contract(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_neighbours_equal_brute_force_over_blocks(spark, monkeypatch):
    import driftloom.operators.neighbours as module

    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [("k", "t", i, i % 5, x[i].tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, tag string, vec_id long, label int, u array<double>")
    monkeypatch.setattr(module, "packed", lambda r, keys, block=70, f=module.packed: f(r, keys, block))
    got = {}
    for r in nearest(df, df, ["key"], 4, other_than_self=True).collect():
        got.setdefault(r["vec_id"], {})[r["rank"]] = r["near_id"]
    for i in range(300):
        order = [j for j in np.argsort(-(x @ x[i]), kind="stable") if j != i][:4]
        assert [got[i][k] for k in range(1, 5)] == order


def test_similarities_leave_no_row_out(spark, monkeypatch):
    import driftloom.operators.neighbours as module

    x = np.random.default_rng(1).standard_normal((300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([("k", "t", i, i % 5, x[i].tolist()) for i in range(300)], "key string, tag string, vec_id long, label int, u array<double>")
    monkeypatch.setattr(module, "packed", lambda r, keys, block=70, f=module.packed: f(r, keys, block))
    got = {r["vec_id"]: r for r in module.similarities(df.filter("vec_id % 50 = 0"), df, ["key"]).collect()}
    assert set(got) == set(range(0, 300, 50))
    for i, r in got.items():
        assert r["n"] == 300 and np.allclose([r["mean"], r["most"], r["least"]], [(s := x @ x[i]).mean(), s.max(), s.min()])


def test_similarity_makes_no_row_of_a_pair(spark, sf):
    import __spark_entry__

    plan = __spark_entry__.queries()["c11_similarity_matrix"](spark, sf)._jdf.queryExecution().toString()
    assert "near_id" not in plan and "1000000" not in plan


def test_mmd_identity_and_zero():
    x = np.random.default_rng(1).standard_normal((40, 6))
    y = x + 1.5
    gamma = median_gamma(np.concatenate([x, y]))
    aa, bb, ab = kernel_terms(x, y, gamma)
    assert aa + bb - 2 * ab > 0.1
    aa, bb, ab = kernel_terms(x, x, gamma)
    assert abs(aa + bb - 2 * ab) < 1e-12


def test_ledoit_wolf_against_the_definition():
    x = np.random.default_rng(2).standard_normal((50, 4)) @ np.diag([1, 2, 3, 4])
    c = x - x.mean(0)
    s = c.T @ c / 50
    mu = np.trace(s) / 4
    d2 = ((s - mu * np.eye(4)) ** 2).sum() / 4
    b2 = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in c) / 50**2 / 4, d2)
    want = (b2 / d2) * mu * np.eye(4) + (1 - b2 / d2) * s
    _, got, _ = ledoit_wolf(50, c.sum(0), c.T @ c, ((c * c).sum(1) ** 2).sum())
    assert np.allclose(got, want)


def test_auc_of_negated_scores(spark):
    rows = spark.createDataFrame([(1, 0.1), (0, 0.1), (0, 0.3), (1, 0.4), (1, 0.8), (0, 0.8), (0, 0.05)], "failure int, score double").withColumn("g", F.lit("g"))
    a = auc(rows, ["g"]).first()["auc"]
    b = auc(rows.withColumn("score", -F.col("score")), ["g"]).first()["auc"]
    assert abs(a + b - 1) < 1e-12


def test_best_f1_by_hand(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.7), (1, 0.2), (0, 0.1)], "failure int, score double").withColumn("g", F.lit("g"))
    r = best_f1(rows, ["g"]).first()
    assert r["best_threshold"] == 0.2 and abs(r["best_f1"] - 6 / 7) < 1e-6


def test_tails_at_known_points():
    assert abs(tails.t_two_sided(2.228138852, 10) - 0.05) < 1e-8
    assert abs(tails.chi2_upper(5.991464547, 2) - 0.05) < 1e-9
    assert abs(tails.f_upper(4.102821, 2, 10) - 0.05) < 1e-6
    assert abs(tails.normal_two_sided(1.959963985) - 0.05) < 1e-9
    assert tails.pearson_p(1.0, 10) == 0.0 and math.isnan(tails.pearson_p(0.5, 2))


def test_studentised_range():
    """Critical values at 5 %: q / sqrt(2) for 2, 4 and 10 treatments."""
    for k, q in ((2, 1.960), (4, 2.569), (10, 3.164)):
        assert abs(tails.studentised_range_upper(q * math.sqrt(2), k) - 0.05) < 3e-4


def test_mixed_model_recovers_parameters():
    from driftloom.plans.statistics import mixed_model

    rng = np.random.default_rng(4)
    groups = []
    for _ in range(200):
        x = rng.random(30)
        y = (0.1 + rng.normal(0, 0.2)) + (0.7 + rng.normal(0, 0.3)) * x + rng.normal(0, 0.1, 30)
        v = np.stack([np.ones(30), x, y])
        groups.append(v @ v.T)
    b0, b1, se, v0, v1, s2 = mixed_model(groups)
    assert abs(b0 - 0.1) < 0.05 and abs(b1 - 0.7) < 0.08 and 0.015 < se < 0.04
    assert abs(v0 - 0.04) < 0.012 and abs(v1 - 0.09) < 0.03 and abs(s2 - 0.01) < 0.001


def test_components_of_a_map():
    assert components(np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0]])) == 2
    assert components(np.zeros((4, 4), int)) == 1
    assert components(np.array([[0, 1, 2], [1, 2, 0]])) == 4


def test_certified_flips_are_none(spark, sf):
    assert registry.queries()["k12_margin_gate"](spark, sf).filter("certified_flips > 0").count() == 0


def test_results_do_not_depend_on_partitions(spark, sf):
    name = "o2_bootstrap_mean"
    first = sorted(map(tuple, registry.queries()[name](spark, sf).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        assert sorted(map(tuple, registry.queries()[name](spark, sf).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_records_are_complete(spark, sf):
    r = records(spark, sf)
    assert r.count() == 84 and r.select("dataset", "backbone", "tag").distinct().count() == 84
    assert r.filter("accuracy < 0 OR accuracy > 1 OR acc_clean <> 1").count() == 0
    assert neighbour_lists(spark, sf).groupBy("dataset", "backbone", "tag", "vec_id").count().filter("count <> 10").count() == 0


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = registry.queries()["f8_halves"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint,label:int>" in plan
    plan = registry.queries()["b12_classes_with_two"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: []" in plan and "ReadSchema: struct<label:int>" in plan  # every row counts, one column is read
    plan = registry.queries()["b3_point_lookup"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan


def test_image_functions():
    from driftloom.functions import images

    x = np.random.default_rng(0).random((3, 8, 8))
    assert np.allclose(images.rotation(x, 0), x) and np.allclose(images.rotation(images.rotation(x, 90), -90), x)
    assert np.allclose(images.pixelate(x, 1.0), x) and np.allclose(images.resize_zoom(x, 1.0), x)
    assert np.allclose(images.contrast(x, 1.0), x) and np.allclose(images.brightness(x, 1.0), x)
    flat = np.full((3, 8, 8), 0.4)
    for f in (lambda i: images.gaussian_blur(i, 1.0), lambda i: images.defocus(i, 2), lambda i: images.motion_blur(i, 4), lambda i: images.zoom_blur(i, 0.3)):
        assert np.allclose(f(flat), flat)
    wrapped = images.defocus(x, 1, "wrap")
    assert abs(wrapped.mean() - x.mean()) < 1e-12
    assert np.abs(images.wiener(wrapped, 1) - x).mean() < np.abs(wrapped - x).mean()
    assert (images.gaussian_noise(x, 0.1, 3) == images.gaussian_noise(x, 0.1, 3)).all()
    assert ((images.impulse_noise(x, 1.0, 1) == 0) | (images.impulse_noise(x, 1.0, 1) == 1)).all()
    assert np.allclose(images.guided_filter(flat[0], flat[0]), flat[0])
    assert abs(images.ssim(x, x) - 1) < 1e-12 and images.ssim(x, 1 - x) < 0.5
    assert np.abs(images.jpeg(flat, 90) - flat).max() < 0.02
    assert np.abs(images.jpeg(x, 95) - x).mean() < np.abs(images.jpeg(x, 10) - x).mean()
    dark = x * 0.2
    assert images.illumination_corrected(dark).mean() > dark.mean()
    for name, value in (("compound", "mild"), ("scratch", "2"), ("green_channel_shift", "20")):
        assert images.make(name, value)(x, 1).shape == x.shape


def test_silhouette_equals_all_pairs(spark):
    from driftloom.functions.vectors import unit
    from driftloom.plans.base import clean_bank
    from driftloom.registry import queries

    sf = "/root/testdata/sf0.1"  # over 400 rows of each dataset
    rows = clean_bank(spark, sf).select("dataset", "backbone", "label", unit(F.col("x")).alias("u")).toPandas()
    got = {(r["dataset"], r["backbone"]): r for r in queries()["p6_silhouette"](spark, sf).collect()}
    assert len(got) == 12
    for key, g in rows.groupby(["dataset", "backbone"]):
        u, label = np.stack(g["u"]), g["label"].to_numpy()
        far = 1 - u @ u.T
        np.fill_diagonal(far, 0)
        value = []
        for i, c in enumerate(label):
            mean = {k: far[i, label == k].sum() / ((label == k).sum() - (k == c)) for k in np.unique(label)}
            a, b = mean.pop(c), min(mean.values())
            value.append((b - a) / max(a, b))
        assert got[key]["n"] == len(g) and abs(got[key]["silhouette"] - np.mean(value)) < 2e-6


def test_bootstrap_has_auc_precision_and_f1(spark, sf):
    from driftloom.plans.metrics import auc, best_f1, curve
    from driftloom.plans.resampling import AUC, bootstrap_rows
    from driftloom.registry import queries

    got = {r["metric"]: r for r in queries()["o3_bootstrap_auc"](spark, sf).collect()}
    rows = records(spark, sf).select(F.lit("all").alias("g"), "dataset", "backbone", "tag", "failure", F.col("drift").alias("score"))
    drawn = bootstrap_rows(rows, ["g"], ["dataset", "backbone", "tag"], AUC, "auc")
    c = curve(drawn, ["replicate"]).filter("p > 0 AND n > 0").groupBy("replicate").agg(F.sum(F.expr("dp / p * tp / (tp + fp)")).alias("a"))
    want = {"roc_auc": auc(drawn, ["replicate"]).agg(F.avg("auc")), "avg_precision": c.agg(F.avg("a")), "best_f1": best_f1(drawn, ["replicate"]).agg(F.avg("best_f1"))}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k]["lo"] <= got[k]["mean"] <= got[k]["hi"] and abs(got[k]["mean"] - v.first()[0]) < 1e-5


def test_permutation_tails_of_every_condition(spark, sf):
    from driftloom.plans.resampling import null_accuracy
    from driftloom.registry import queries

    rng = np.random.default_rng(4)
    true, predicted = rng.choice(4, 60, p=[0.4, 0.3, 0.2, 0.1]), rng.integers(0, 4, 60)
    got = null_accuracy(np.bincount(true, minlength=4), np.bincount(predicted, minlength=4), 20_000, 1)
    want = np.array([(rng.permutation(true) == predicted).sum() for _ in range(20_000)])
    assert abs(got.mean() - want.mean()) < 0.15 and abs(got.std() - want.std()) < 0.1
    assert np.abs(np.bincount(got, minlength=61) - np.bincount(want, minlength=61)).max() < 400
    rows = queries()["o7_permutation_tail"](spark, sf).collect()
    assert len({(r["dataset"], r["backbone"], r["tag"]) for r in rows}) == len(rows) == 96
    assert all(r["below"] + r["above"] > 1 - 1e-9 for r in rows)


def test_cross_space_partial_correlation(spark, sf):
    """The residuals of a least-squares fit on one-hot factors, in NumPy."""
    from driftloom.plans.completions import stacked

    rows = stacked(spark, sf).filter("x <> y").collect()
    factors = [np.array([r[c] for r in rows]) for c in ("dataset", "perturbation", "severity")]
    design = np.concatenate([np.ones((len(rows), 1)), *[(f[:, None] == np.unique(f)[None, 1:]).astype(float) for f in factors]], axis=1)
    residual = lambda v: v - design @ np.linalg.lstsq(design, v, rcond=None)[0]
    x, y = (residual(np.array([r[c] for r in rows])) for c in ("drift", "acc_drop"))
    got = registry.queries()["n19_partial"](spark, sf).first()
    assert got["n"] == len(rows) and abs(got["partial_r"] - np.corrcoef(x, y)[0, 1]) < 1e-5


def test_neighbours_of_many_blocks(spark):
    """Blocks of seven vectors, one key with most rows, ties by label and id, any dimension."""
    from driftloom.operators.neighbours import nearest

    rng = np.random.default_rng(0)
    sets = {"big": rng.integers(-2, 3, (60, 5)).astype(float) + 0.1, "small": rng.normal(size=(4, 5))}
    sets = {k: x / np.linalg.norm(x, axis=1, keepdims=True) for k, x in sets.items()}
    rows = [(k, "t", i, i % 3, v.tolist()) for k, x in sets.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, tag string, vec_id long, label int, u array<double>")
    got = {}
    for r in nearest(df, df, ["k"], 6, other_than_self=True, block=7).collect():
        got.setdefault((r["k"], r["vec_id"]), {})[r["rank"]] = (r["near_label"], r["near_id"])
    for k, x in sets.items():
        sim = x @ x.T
        for i in range(len(x)):
            best = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-round(sim[i, j], 12), j % 3, j))[:6]
            values = [round(float(sim[i, j]), 9) for j in best]
            mine = [got[k, i][n + 1] for n in range(len(best))]
            assert [round(float(sim[i, j]), 9) for _, j in mine] == values and len(got[k, i]) == len(best)
