"""Archives of arrays: round trip, pruning, pushed filters, and writes that fail."""

from __future__ import annotations

import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.sources import archives


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("archives")
    rng = np.random.default_rng(0)
    for k, n in enumerate((500, 7, 0)):
        np.savez_compressed(at / f"B{k}_D0_clean.npz", features=rng.normal(size=(n, 6)).astype(np.float32), labels=rng.integers(0, 9, n), paths=np.array([f"a/é{i}/x.png" for i in range(n)], dtype=np.str_), maps=rng.normal(size=(n, 2, 3)), applied=np.array("yes"))
    return str(at)


def test_rows_are_those_of_the_arrays(spark, folder):
    got = {(r["archive"], r["row"]): r for r in archives.read(spark, folder, rows_per_partition=64).collect()}
    assert len(got) == 507
    with np.load(f"{folder}/B0_D0_clean.npz") as z:
        for i in (0, 63, 64, 499):
            r = got["B0_D0_clean", i]
            assert r["features"] == z["features"][i].tolist() and r["labels"] == z["labels"][i] and r["paths"] == z["paths"][i] and r["maps"] == z["maps"][i].tolist()
    assert archives.read(spark, folder, rows_per_partition=64).rdd.getNumPartitions() == 8 + 1


def test_pruned_members_are_not_opened(spark, folder, tmp_path):
    """A member that can't be read does no harm where its column isn't asked for."""
    bad = tmp_path / "X.npz"
    with zipfile.ZipFile(f"{folder}/B1_D0_clean.npz") as a, zipfile.ZipFile(bad, "w") as b:
        for x in a.namelist():
            data = a.read(x)
            b.writestr(x, data[: len(data) // 2] if x == "features.npy" else data)
    assert archives.read(spark, str(bad), ["labels", "row"]).count() == 7
    df = archives.read(spark, str(bad), ["labels"])
    assert "features" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 7
    with pytest.raises(Exception, match="ends early"):
        archives.read(spark, str(bad), ["features"]).collect()


def test_filters_make_fewer_partitions(spark, folder):
    df = archives.read(spark, folder, ["archive", "row", "labels"], rows_per_partition=50).filter("archive = 'B0_D0_clean' AND row >= 120 AND row < 180 AND labels >= 0")
    assert df.rdd.getNumPartitions() == 2
    assert sorted(r["row"] for r in df.collect()) == list(range(120, 180))
    assert archives.read(spark, folder).filter("archive IN ('B1_D0_clean', 'none')").count() == 7
    assert archives.read(spark, folder).filter("row = 3").count() == 2 and archives.read(spark, folder).filter("archive = 'none'").count() == 0
    assert archives.read(spark, folder).filter("row = 3 AND row > 3").count() == 0


def test_round_trip_append_and_overwrite(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    df = archives.read(spark, folder).repartition(3)
    archives.write(df, out, rows_per_archive=40)
    back = archives.read(spark, out)
    cols = ["features", "labels", "paths", "maps"]
    key = lambda d: sorted(map(str, d.select("archive", *cols).collect()))
    assert key(back) == key(df)
    files = archives.listed(out)
    assert max(archives.members(f)[0].shape[0] for f in files) <= 40 and {archives.archive_name(f) for f in files} == {"B0_D0_clean", "B1_D0_clean"}
    archives.write(df.filter("archive = 'B1_D0_clean'"), out)
    assert archives.read(spark, out).count() == 507 + 7
    archives.write(df.filter("archive = 'B1_D0_clean'"), out, mode="overwrite")
    assert archives.read(spark, out).count() == 7
    assert sorted(os.listdir(out)) == sorted([archives.MANIFEST, *[os.path.basename(f) for f in archives.listed(out)]])


def test_a_failed_task_leaves_nothing(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    df = archives.read(spark, folder)
    archives.write(df, out)
    before = sorted(os.listdir(out))
    broken = df.withColumn("labels", F.when((F.col("archive") == "B0_D0_clean") & (F.col("row") == 499), F.raise_error(F.lit("lost"))).otherwise(F.col("labels")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="lost"):
            archives.write(broken.repartition(4), out, mode=mode, rows_per_archive=10)
        assert sorted(os.listdir(out)) == before and archives.read(spark, out).count() == 507
    # files that a broken commit has moved, or a pending folder, are not seen
    np.savez(f"{out}/B9~stray-0.npz", features=np.zeros((3, 6), np.float32))
    os.mkdir(f"{out}/{archives.PENDING}-dead")
    assert archives.read(spark, out).count() == 507
    with pytest.raises(Exception, match="no nulls"):
        archives.write(df.withColumn("labels", F.lit(None).cast("long")), str(tmp_path / "nulls"))


def test_members_that_are_no_rows(spark, tmp_path):
    np.savez(tmp_path / "o.npz", a=np.array([{}, {}], dtype=object))
    with pytest.raises(Exception, match="pickles"):
        archives.read(spark, str(tmp_path)).collect()
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="no archive"):
        archives.ArrayArchive({"path": str(tmp_path / "empty")}).schema()


def test_fallback_takes_banks_whole(spark):
    new = spark.createDataFrame([("B0", "D0", 1), ("B0", "D0", 2)], "backbone string, dataset string, v int")
    old = spark.createDataFrame([("B0", "D0", 9), ("B1", "D0", 3), (None, "D0", 4)], "backbone string, dataset string, v int")
    assert sorted(r["v"] for r in archives.with_fallback(new, old, ["backbone", "dataset"]).collect()) == [1, 2, 3, 4]


def test_longest_dataset_names(spark):
    known = spark.createDataFrame([("S26",), ("S26_x10",), ("S26_x1",), ("A",), ("A",), ("",)], "dataset string")
    cases = {"S26_x10_blur_1": ("S26_x10", "blur_1"), "S26_x100_blur": ("S26", "x100_blur"), "S26": ("S26", None), "S26_x1_y": ("S26_x1", "y"), "A_": ("A", None), "AB_c": (None, None), "": (None, None), "other": (None, None)}
    names = spark.createDataFrame([(k, i) for i, k in enumerate(cases)] + [(None, 99), ("S26", 98)], "name string, i int")
    got = [(r["name"], r["dataset"], r["rest"]) for r in archives.named_parts(names, known).collect()]
    want = [(k, *v) for k, v in cases.items()] + [(None, None, None), ("S26", "S26", None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
