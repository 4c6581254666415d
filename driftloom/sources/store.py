"""Written tables that many queries share, and the tables of a data folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="driftloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_paths: list[tuple[SparkSession, str]] = []


def fresh_folder(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the process ends."""
    path = f"{shared_folder(spark)}/driftloom-{uuid.uuid4().hex}"
    _paths.append((spark, path))
    return path


def written(df: DataFrame) -> DataFrame:
    """``df``, written once and read back, so its lineage ends there."""
    path = fresh_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _end() -> None:
    """Written tables go with the process that wrote them."""
    for spark, path in _paths:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended before
            return


_kept: dict[tuple[str, str, str], DataFrame] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is made once for a session and a data folder, as a batch of experiments keeps its records."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = written(make())
    return _kept[key]


def kept(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    """The table that ``once`` has made in this session, if it has."""
    return _kept.get((spark.sparkContext.applicationId, sf_dir, name))
