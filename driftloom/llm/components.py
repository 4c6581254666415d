"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise


def components(links: DataFrame, owner: str = "query") -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); ``root`` is the smallest node of its component.

    In a round every node hooks onto its smallest neighbour (an aggregate that is combined before the shuffle, so
    hubs cost no more than others), chains of hooks are shortened, and the links are contracted to those between different
    roots. The number of nodes left falls geometrically. All tables are distributed; each round is written, so lineage stays short.
    """
    links = materialise(links.select("a", "b").filter("a <> b").distinct(), owner)
    both = links.union(links.select("b", "a"))
    roots = materialise(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), owner)
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        hooks = materialise(hooks, owner)
        while True:
            up = hooks.select(F.col("node").alias("to"), F.col("to").alias("next"))
            hooks = materialise(hooks.join(up, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), owner)
            if hooks.filter("moved").isEmpty():
                break
            hooks = hooks.select("node", "to")
        left, right = (hooks.select(F.col("node").alias(c), F.col("to").alias(f"{c}2")) for c in ("a", "b"))
        links = materialise(links.join(left, "a").join(right, "b").select(F.col("a2").alias("a"), F.col("b2").alias("b")).filter("a <> b").distinct(), owner)
        roots = materialise(roots.join(hooks.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), owner)
    return roots
