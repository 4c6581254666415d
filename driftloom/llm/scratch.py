"""Written intermediate tables in the folder that driver and executors share.

``materialise`` cuts lineage by writing Parquet below ``spark.checkpoint.dir``: a lost executor costs
nothing but a reread. The setting is read from the session; only where it is unset and Spark runs in one process (tests)
a temporary folder of this process stands in. On a cluster without the setting it is an error: executors share no local folder.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[tuple[SparkSession, str]]] = {}


def root(spark: SparkSession) -> str:
    """The shared folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="driftloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, owner: str = "query") -> DataFrame:
    """``df``, written once to the shared folder and read back; ``owner`` names the group for ``release``."""
    spark = df.sparkSession
    path = f"{root(spark)}/driftloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(owner, []).append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def steady(df: DataFrame, owner: str = "query") -> DataFrame:
    """``df``, written first if a shuffle makes it: a task that runs again must read the same rows in the same order."""
    return materialise(df, owner) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def release(owner: str = "query") -> None:
    """Delete the tables of ``owner``; call it only when nothing unread depends on them."""
    for spark, path in _written.pop(owner, []):
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended: its folder goes with it
            return


@atexit.register
def _end() -> None:
    for owner in list(_written):
        release(owner)
