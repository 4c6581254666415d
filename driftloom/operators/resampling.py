"""Deterministic resampling: draws come from hashes of seed, replicate and position, so any task repeats them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_number(*parts: Column) -> Column:
    """A number from the first 8 hex digits of the md5 of the parts joined by ``|``."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def bootstrap_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str], replicates: int, seed: str) -> DataFrame:
    """Rows with a column ``replicate``: of each key n draws with replacement for every replicate.

    Rows are numbered once; draw i of replicate b is the row numbered hash(seed, b, i) mod n, found by a join on the number.
    """
    w = Window.partitionBy(*keys)
    numbered = rows.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    draws = numbered.select(*keys, "_i", "_n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    draws = draws.select(*keys, "replicate", (hash_number(F.lit(seed), F.col("replicate"), F.col("_i")) % F.col("_n")).alias("_i"))
    return draws.join(numbered.drop("_n"), [*keys, "_i"]).drop("_i")


def hash_order(seed: str, *parts: str) -> list[Column]:
    return [F.md5(F.concat_ws("|", F.lit(seed), *[F.col(p).cast("string") for p in parts])), *[F.col(p) for p in parts]]


def without_replacement(rows: DataFrame, keys: Sequence[str], most: int | Column, seed: str, id_col: str) -> DataFrame:
    """At most ``most`` rows of each key, in hash order (a sampling operator)."""
    order = Window.partitionBy(*keys).orderBy(*hash_order(seed, id_col))
    return rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r")
