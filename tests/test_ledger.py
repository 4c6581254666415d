"""Extraction grids that are interrupted, and folders of labelled files."""

from __future__ import annotations

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftloom.sources.folders import labelled_files
from driftloom.sources.ledger import Ledger


def loader(folder, fail=None):
    def load(model):
        with open(f"{folder}/loads-{model}-{os.getpid()}", "a") as f:
            f.write("x")

        def extract(batch):
            with open(f"{folder}/cells-{model}", "a") as f:
                f.write(f"{batch.num_rows},")
            if model == fail:
                raise RuntimeError("killed")
            return pa.RecordBatch.from_pydict({"item": batch.column(0), "twice": pa.array([int(model) * 2 * x for x in batch.column(0).to_pylist()], pa.int64())})

        return extract

    return load


def test_a_killed_grid_resumes(spark, tmp_path):
    cells = spark.createDataFrame([(str(b), d) for b in range(1, 5) for d in ("D0", "D1", "empty")], "backbone string, dataset string")
    items = spark.createDataFrame([(i, f"D{i % 2}") for i in range(40)], "item long, dataset string").repartition(3)
    schema = "item long, twice long"
    store = str(tmp_path / "store")
    ledger = Ledger(spark, store, ["backbone", "dataset"])
    with pytest.raises(Exception, match="killed"):
        ledger.run(cells, items, ["dataset"], "backbone", loader(tmp_path, fail="3"), schema, wave=3)
    got = {(r["backbone"], r["dataset"]) for r in ledger.committed().collect()}
    assert got == {(b, d) for b in "12" for d in ("D0", "D1", "empty")}  # whole waves before the failure
    assert ledger.read(schema).count() == 2 * 40 and not [f for f in os.listdir(store) if f.startswith("staging")]
    before = os.path.getsize(tmp_path / "cells-1")
    os.makedirs(f"{store}/cells/id=stray")  # of a run that ended before its entry was written
    spark.createDataFrame([(7, 7)], schema).write.mode("overwrite").parquet(f"{store}/cells/id=stray")
    again = Ledger(spark, store, ["backbone", "dataset"])
    assert again.run(cells, items, ["dataset"], "backbone", loader(tmp_path), schema, wave=4) == 6
    assert os.path.getsize(tmp_path / "cells-1") == before  # nothing is done twice
    rows = again.read(schema)
    assert rows.count() == 4 * 40 and rows.filter("twice <> item * 2 * cast(backbone as long)").count() == 0
    assert again.run(cells, items, ["dataset"], "backbone", loader(tmp_path), schema) == 0


def test_models_are_loaded_once_a_worker(spark, tmp_path):
    cells = spark.createDataFrame([("5", d) for d in ("D0", "D1")], "backbone string, dataset string")
    items = spark.createDataFrame([(i, f"D{i % 2}") for i in range(50)], "item long, dataset string").repartition(6)
    Ledger(spark, str(tmp_path / "s"), ["backbone", "dataset"]).run(cells, items, ["dataset"], "backbone", loader(tmp_path), "item long, twice long")
    loads = [f for f in os.listdir(tmp_path) if f.startswith("loads-5")]
    assert loads and all(os.path.getsize(tmp_path / f) == 1 for f in loads)


def test_labelled_files(spark, tmp_path):
    tree = {"b oak": 10, "a": 5, "é+%": 3, "one": 1, ".hidden": 4, "_skip": 4, "c": 2}
    for folder, n in tree.items():
        os.mkdir(tmp_path / folder)
        for i in range(n):
            (tmp_path / folder / f"{i}.{('JPG', 'png')[i % 2]}").write_bytes(b"x" * (i + 1))
        (tmp_path / folder / "notes.txt").write_text("no image")
    (tmp_path / "loose.png").write_bytes(b"x")
    found = labelled_files(spark, str(tmp_path)).collect()
    assert {(r["folder"], r["label"]) for r in found} == {("a", 0), ("b oak", 1), ("c", 2), ("é+%", 3)}
    assert len(found) == 20 and all(r["length"] == int(r["path"].rsplit("/", 1)[1].split(".")[0]) + 1 for r in found)
    val, train = (labelled_files(spark, str(tmp_path), split=s).collect() for s in ("val", "train"))
    assert sorted([*val, *train]) == sorted(found)
    counts = {f: sum(r["folder"] == f for r in val) for f in ("a", "b oak", "c", "é+%")}
    assert counts == {"a": 1, "b oak": 2, "c": 1, "é+%": 1}
    some = labelled_files(spark, str(tmp_path), most=7).collect()
    assert len(some) == 7 and sorted(some) == sorted(labelled_files(spark, str(tmp_path), most=7).collect())
    plan = labelled_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan  # contents are not read
