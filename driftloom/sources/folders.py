"""Labelled files: a folder of class folders as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values.
SUFFIXES = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp")


def labelled_files(spark: SparkSession, root: str, suffixes: Sequence[str] = SUFFIXES, least: int = 2, split: str = "all", share: float = 0.2, most: int | None = None, seed: str = "files") -> DataFrame:
    """path, folder, label, length: the files with one of ``suffixes`` (of any case) in the class folders right below ``root``.

    Folders with fewer than ``least`` files, and those whose name begins with a dot or an underscore, don't count; labels number the others in the order of their names. ``split``
    (all, train or val) takes from each class the ``share`` of least hash, one file at least, as val. Of the result ``most`` files of least
    hash stay (a sampling option), wherever they are: each task keeps that many of its own. Contents are read only if the caller joins them.
    """
    files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/*").select("path", "length")
    parts = F.split("path", "/")
    files = files.select("path", F.element_at(parts, -2).alias("folder"), "length")
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    files = files.filter(ending.isin([s.lower() for s in suffixes]) & ~F.col("folder").rlike("^[._]"))
    classes = files.groupBy("folder").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    classes = classes.withColumn("label", F.row_number().over(Window.orderBy("folder")) - 1)  # a row for each class
    rows = files.join(classes, "folder").withColumn("_order", F.md5(F.concat_ws("|", F.lit(seed), F.concat_ws("/", "folder", F.element_at(parts, -1)))))
    if split != "all":
        place = F.row_number().over(Window.partitionBy("folder").orderBy("_order", "path"))
        val = place <= F.greatest(F.lit(1), F.floor(F.col("n") * share))
        rows = rows.withColumn("_val", val).filter(F.col("_val") if split == "val" else ~F.col("_val"))
    if most is not None:
        rows = rows.orderBy("_order", "path").limit(most)
    return rows.select("path", "folder", "label", "length")
