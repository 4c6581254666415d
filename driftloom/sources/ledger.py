"""A resumable grid of extraction jobs.

A grid's cells (say space x dataset x condition) are rows of a table. Cells that are still due are those of the grid that the ledger doesn't
list, by an anti-join; they are worked on in waves. A wave is one Spark job: items are joined to its cells, a user's function turns batches
of them into output rows (``mapInArrow``; what ``load`` returns for a model is kept by the worker, so each model is loaded once a worker), and the
output is written by cell into a staging folder. Then the wave's cells are committed one by one: the cell's folder is renamed into the
store and a one-line entry is renamed into the ledger. Readers see only cells that the ledger lists, so a run that is killed anywhere leaves
no half cell, and the next run takes up where it ended. Cells without any item are committed empty.

Renames go through Spark's own file system, so the folder may be wherever Spark can write. One run at a time.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

Extract = Callable[[pa.RecordBatch], pa.RecordBatch]
_loaded: dict[tuple[str, str], Extract] = {}


def cell_id(values: Sequence[str]) -> str:
    return hashlib.sha256(json.dumps(list(values)).encode()).hexdigest()[:24]


class Ledger:
    """The committed cells of a folder; ``keys`` name a cell's columns (strings)."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), list(keys)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        for part in ("cells", "ledger"):
            self._fs.mkdirs(self._path(f"{self.folder}/{part}"))

    def committed(self) -> DataFrame:
        """The keys of committed cells, and id."""
        schema = ", ".join(f"`{k}` string" for k in [*self.keys, "id"])
        return self.spark.read.schema(schema).json(f"{self.folder}/ledger")

    def due(self, cells: DataFrame) -> DataFrame:
        """The grid's cells that are not committed."""
        return cells.select(*[F.col(k).cast("string").alias(k) for k in self.keys]).distinct().join(self.committed(), self.keys, "left_anti")

    def read(self, schema: str) -> DataFrame:
        """The rows of all committed cells, with their keys."""
        ids = self.spark.read.option("basePath", f"{self.folder}/cells").schema(f"{schema}, id string").parquet(f"{self.folder}/cells")
        return ids.join(self.committed(), "id").drop("id")

    def _commit(self, cell: Row, staging: str) -> None:
        name = cell_id([cell[k] for k in self.keys])
        made, stored = self._path(f"{staging}/id={name}"), self._path(f"{self.folder}/cells/id={name}")
        if self._fs.exists(stored):  # of a run that ended between the two renames
            self._fs.delete(stored, True)
        if self._fs.exists(made) and not self._fs.rename(made, stored):
            raise RuntimeError(f"{made} could not be moved")
        entry, listed = self._path(f"{staging}/{name}.json"), self._path(f"{self.folder}/ledger/{name}.json")
        out = self._fs.create(entry, True)
        out.write(bytearray((json.dumps({k: cell[k] for k in self.keys} | {"id": name}) + "\n").encode()))
        out.close()
        if not self._fs.rename(entry, listed):
            raise RuntimeError(f"{entry} could not be moved")

    def run(self, cells: DataFrame, items: DataFrame, on: Sequence[str], model: str, load: Callable[[str], Extract], schema: str, wave: int = 16) -> int:
        """Work on all due cells; the number of cells committed.

        ``items`` meet the cells on the columns ``on``. ``load`` gets a cell's ``model`` column and returns a function of record batches (the items'
        columns) to record batches of ``schema``, row counts free. At most ``wave`` cells are one job.
        """
        done, token = 0, uuid.uuid4().hex
        cols = items.columns
        names = [f.name for f in self.spark.createDataFrame([], schema).schema.fields]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from driftloom.sources.ledger import _loaded as kept  # the worker's own, which outlives the task

            for batch in batches:
                both = pa.Table.from_batches([batch])
                for key in set(zip(both["id"].to_pylist(), both["_model"].to_pylist(), strict=True)):
                    if (token, key[1]) not in kept:
                        kept[token, key[1]] = load(key[1])
                    some = both.filter(pa.compute.equal(both["id"], key[0])).select(cols).combine_chunks()
                    for part in some.to_batches():
                        out = kept[token, key[1]](part)
                        yield pa.RecordBatch.from_arrays([*(out.column(n) for n in names), pa.array([key[0]] * out.num_rows, pa.string())], [*names, "id"])

        while True:
            some = self.due(cells).orderBy(*self.keys).limit(wave).collect()  # a wave
            if not some:
                return done
            staging = f"{self.folder}/staging-{uuid.uuid4().hex}"
            ids = [(*[c[k] for k in self.keys], cell_id([c[k] for k in self.keys])) for c in some]
            table = self.spark.createDataFrame(ids, ", ".join(f"`{k}` string" for k in [*self.keys, "id"]))
            try:
                wanted = items.join(F.broadcast(table.withColumn("_model", F.col(model))), list(on))  # at most ``wave`` rows
                made = wanted.select(*cols, "id", "_model").mapInArrow(run, f"{schema}, id string")
                made.write.partitionBy("id").parquet(staging)
                for cell in some:
                    self._commit(cell, staging)
                    done += 1
            finally:
                self._fs.delete(self._path(staging), True)
