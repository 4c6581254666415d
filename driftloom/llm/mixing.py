"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Targets: sources, in code point order (null last), weigh by the repeating list of weights and share a part of all
words. No target exceeds ``most`` times its source's size; the excess is shared by weight until none does. That is
the water level found here in one pass over the sources in order of size per weight.

Sampling: every document of a source expects the same number of copies, target / size. Along the source's documents
(by stratum of size, then bucket, size and id) the expected copies are summed up, a random offset is added, and a
document is emitted once for each integer that its interval crosses. Sorting by size makes the words taken stay close to
the target. The prefix sum is computed at three levels (strata of a source, buckets of a stratum, rows of a bucket), so a
source with a third of all rows is never one task's work.

Texts are read to count words and, by ``mix``, once more to be emitted: all sampling is done on narrow rows (id, source, size,
hash of the row), which are written once. Their result is joined to the texts as the build side of a hash join, so texts are dealt
once and never sorted.

Defined results: null text has size 0; sources without words get target 0 and give nothing; null ids are sampled like
others; repeated rows are sampled apart; of ties in size and id the hash of the whole row decides, and rows that are equal in
all columns are exchangeable; a very long text is one row of its size; an empty table gives an empty result; other
columns are kept by ``mix`` and ignored by ``plan``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise

WEIGHTS = (5, 2, 1)
BUCKETS = 256


def words(text: Column) -> Column:
    """Number of words: runs of other characters than x20 and x09 to x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: float = 3.0) -> DataFrame:
    """source, source_size, target: from one row (source, source_size) for each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    table = sizes.withColumn("weight", pick).withColumn("ceiling", F.col("source_size") * F.lit(float(most)))
    by_level = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumns({
        "total": F.sum("source_size").over(everything) * F.lit(float(share)),
        "full": F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    # the level if all sources before this one are at their ceilings; the first that stays below its own ceiling sets it
    table = table.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    table = table.withColumn("water", F.min(F.when(F.col("level") * F.col("weight") <= F.col("ceiling"), F.struct(F.col("ceiling") / F.col("weight"), F.col("level").alias("level")))).over(everything)["level"])
    return table.select("source", "source_size", F.when(F.col("water").isNull(), F.col("ceiling")).otherwise(F.least(F.col("ceiling"), F.col("water") * F.col("weight"))).alias("target"))


def hashed(seed: str, value: Column, digits: int) -> Column:
    """A number in [0, 1) of ``digits`` hex digits, the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(value.cast("string"), F.lit("")))), 1, digits), 16, 10).cast("double") / F.lit(float(16**digits))


def _sampled(rows: DataFrame, weights: Sequence[float], share: float, most: float, seed: str, owner: str) -> DataFrame:
    """Narrow rows (doc_id, source, size and any others) with source_size, target and copies."""
    rows = rows.withColumns({
        "stratum": F.floor(F.log2(F.col("size") + F.lit(1.0)) * 4).cast("int"),
        "bucket": F.floor(hashed(seed, F.col("doc_id"), 2) * BUCKETS).cast("int"),
        "has": F.col("source").isNotNull(),
        "name": F.coalesce("source", F.lit("")),
    })
    key = ["has", "name", "stratum", "bucket"]
    rows = materialise(rows, owner)  # words are counted once
    buckets = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    strata = buckets.groupBy("has", "name", "stratum").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    goal = targets(strata.groupBy("has", "name").agg(F.sum("words").alias("source_size")).select(F.when(F.col("has"), F.col("name")).alias("source"), "source_size"), weights, share, most)
    goal = goal.select(F.col("source").isNotNull().alias("has"), F.coalesce("source", F.lit("")).alias("name"), "source_size", "target")
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    lower = strata.select("has", "name", "stratum", F.coalesce(F.sum("n").over(past(Window.partitionBy("has", "name").orderBy("stratum"))), F.lit(0)).alias("lower"))
    inner = buckets.select(*key, F.coalesce(F.sum("n").over(past(Window.partitionBy("has", "name", "stratum").orderBy("bucket"))), F.lit(0)).alias("inner"))
    base = inner.join(lower, ["has", "name", "stratum"]).join(goal, ["has", "name"]).select(*key, (F.col("inner") + F.col("lower")).alias("base"), "source_size", "target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # an offset of few binary digits: at a whole ratio no sum is rounded across an integer
    offset = (F.floor(hashed(f"{seed}/offset", F.col("name"), 3) * 1024) + F.lit(0.5)) / F.lit(1024.0)
    rank = F.col("base") + F.row_number().over(Window.partitionBy(*key).orderBy("size", "doc_id", *[c for c in ("mark",) if c in rows.columns]))
    copies = F.floor(rank * ratio + offset) - F.floor((rank - 1) * ratio + offset)
    return rows.join(base, key).withColumn("copies", copies.cast("long"))


def _narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), words(F.col(f"`{text_col}`")).alias("size")]


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: float = 3.0, seed: str = "mix", owner: str = "query") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: one row for each row of ``docs``."""
    out = _sampled(docs.select(*_narrow(docs, id_col, text_col, source_col)), weights, share, most, seed, owner)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: float = 3.0, seed: str = "mix", owner: str = "query") -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each row as often as the mix takes it."""
    cols = docs.columns
    mark = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    rows = _sampled(docs.select(*_narrow(docs, id_col, text_col, source_col), mark.alias("mark")), weights, share, most, seed, owner)
    taken = rows.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("copies"))
    taken = materialise(taken.filter("copies > 0"), owner)
    whole = docs.select(F.col(f"`{id_col}`").alias("doc_id"), mark.alias("mark"), F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"))

    def emitted(some: DataFrame, rows: DataFrame) -> DataFrame:
        keys = some.select(F.col("doc_id").alias("its_id"), F.col("mark").alias("its_mark"), "copies").hint("shuffle_hash")
        both = rows.join(keys, F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("mark") == F.col("its_mark")))
        return both.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select(*[F.col(f"row.`{c}`").alias(c) for c in cols])

    out = emitted(taken.filter("rows = 1"), whole)
    if taken.filter("rows > 1").isEmpty():
        return out
    several = taken.filter("rows > 1")  # rows that repeat in every column: one of them gives all copies
    theirs = whole.join(several.select(F.col("mark").alias("its_mark")), F.col("mark") == F.col("its_mark"), "left_semi").dropDuplicates(["doc_id", "mark"])
    return out.unionByName(emitted(several, theirs))
