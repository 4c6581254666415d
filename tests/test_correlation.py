"""Correlations of columns that may be constant, where Spark's own stops with a division by zero."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom import registry
from driftloom.functions import tails
from driftloom.plans.base import correlation


@pytest.fixture(scope="module")
def one_label(spark, tmp_path_factory):
    """Vectors of a single label: no condition ever costs accuracy, so that every drop is 0."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    path = str(tmp_path_factory.mktemp("one_label"))
    spark.createDataFrame([(i, v.tolist(), 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return path


def same_as_sql(spark, path, name):
    found = registry.queries()[name](spark, path)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    want = db.sql(registry.oracle_sql()[name])
    key = lambda row: tuple("NaN" if isinstance(v, float) and math.isnan(v) else v for v in row)
    got, want = [key(r) for r in found.select(*want.columns).collect()], [key(r) for r in want.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and got
    return got


def test_correlation_of_constants_missing_values_and_single_rows(spark):
    rows = {
        "line": [(1.0, 2.0), (2.0, 4.0), (4.0, 8.0)],
        "free": [(1.0, 2.0), (2.0, 1.0), (4.0, 8.0), (None, 3.0), (9.0, None)],
        "still": [(0.1, float(i)) for i in range(7)],  # sums of 0.1 are not exact
        "both": [(0.1, 0.3)] * 7,
        "one": [(1.0, 2.0), (None, 5.0)],
        "none": [(None, 1.0), (2.0, None)],
        "small": [(1e-200, 1.0), (3e-200, 2.0)],
    }
    df = spark.createDataFrame([(k, *r) for k, v in rows.items() for r in v], "k string, x double, y double").repartition(5)
    got = {r["k"]: r["r"] for r in df.groupBy("k").agg(correlation("x", F.col("y")).alias("r")).collect()}
    db = duckdb.connect()
    for k, v in rows.items():
        db.execute("CREATE OR REPLACE TABLE t (x DOUBLE, y DOUBLE)")
        db.executemany("INSERT INTO t VALUES (?, ?)", v)
        want = db.sql("SELECT corr(x, y) FROM t").fetchall()[0][0]
        assert got[k] == want or got[k] == pytest.approx(want, abs=1e-12, nan_ok=True), (k, got[k], want)
    assert got["none"] is None and math.isnan(got["still"]) and got["line"] == 1.0


def test_drops_that_do_not_vary_by_perturbation(spark, one_label):
    assert {r[0]: r[2] for r in same_as_sql(spark, one_label, "n22_by_perturbation")} == dict.fromkeys(("add", "blend", "roll", "scale"), "NaN")


def test_grouped_pearson_of_drops_that_do_not_vary(spark, one_label):
    assert [r[1:] for r in same_as_sql(spark, one_label, "n3_grouped_pearson")] == [(24, "NaN")] * 3


ALSO = ("b11_row_mask", "e11_means_and_corr", "g2_by_absolute", "m12_detector_correlation", "n1_pearson", "n2_spearman", "n4_partial_one_factor", "n7_subset_sensitivity", "n19_cross_space", "n19_pooled", "n23_multilevel_table", "n24_tier_comparison", "v9_without_dataset")


@pytest.mark.parametrize("name", ALSO)
def test_others_of_drops_that_do_not_vary(spark, one_label, name):
    same_as_sql(spark, one_label, name)


def test_p_of_an_unknown_correlation_is_unknown(spark, one_label):
    assert math.isnan(tails.pearson_p(float("nan"), 21))
    assert {(math.isnan(r["p"]), r["stars"]) for r in registry.queries()["n1_pearson_p"](spark, one_label).collect()} == {(True, "n.s.")}
