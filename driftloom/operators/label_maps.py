"""Clusters of 8 x 8 maps in column expressions: centres, soft weights, edge-keeping refinement, labels, and their clean-up on bitboards.

Every map is a row of its own; nothing is shuffled and no Python worker runs. Steps are columns, so each is computed once for a map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions import bitboards as bb

CLUSTERS, ROUNDS = 3, 10
#: Regularisation of the guided filter and the size of the opening's ellipse.
GUIDED_EPS, KERNEL = 1e-4, 3


def _at(v: str, places: list[int]) -> Column:
    table = F.array(*[F.lit(p) for p in places])
    return F.transform(F.sequence(F.lit(0), F.lit(bb.CELLS - 1)), lambda i: F.get(F.col(v), F.get(table, i)))


def _mirrored(step: int, by: int) -> list[int]:
    """For each cell the one ``by`` further along a row (step 1) or column (step 8); a border reflects without repeating itself."""
    out = []
    for i in range(bb.CELLS):
        k = (i // step) % bb.SIDE
        to = k + by
        to = -to if to < 0 else 2 * (bb.SIDE - 1) - to if to >= bb.SIDE else to
        out.append(i + (to - k) * step)
    return out


def box(rows: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """For every (new, old) of ``pairs`` the means of 3 x 3 cells."""
    for step in (1, bb.SIDE):
        mean = {new: F.transform(F.arrays_zip(_at(v, _mirrored(step, -1)).alias("a"), F.col(v).alias("b"), _at(v, _mirrored(step, 1)).alias("c")), lambda t: (t["a"] + t["b"] + t["c"]) / 3) for new, v in pairs.items()}
        rows = rows.withColumns(mean)
        pairs = {new: new for new in pairs}
    return rows


def centres(v: str) -> Column:
    """Three centres of the values, ascending, by Lloyd's steps from the sixths of their order; an empty cluster keeps its centre."""
    ordered = F.array_sort(v)
    start = F.array(*[F.get(ordered, F.lit(int(bb.CELLS * (2 * k + 1) / (2 * CLUSTERS)))) for k in range(CLUSTERS)])

    def step(c: Column, _: Column) -> Column:
        low, high = (c[0] + c[1]) / 2, (c[1] + c[2]) / 2
        out = []
        for k, test in enumerate((lambda x: x <= low, lambda x: (x > low) & (x <= high), lambda x: x > high)):
            total = F.aggregate(F.filter(F.col(v), test), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda t, x: F.struct((t["s"] + x).alias("s"), (t["n"] + 1).alias("n")), lambda t: F.when(t["n"] > 0, t["s"] / t["n"]))
            out.append(F.coalesce(total, c[k]))
        return F.array(*out)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def spatial_labels(maps: DataFrame, value: str = "v", least_area: float = 1.0) -> DataFrame:
    """``maps`` (with an array of 64 numbers) with centres, weights (64 x 3, refined), raw0..raw2 and set0..set2.

    Weights are the normalised exponentials of the negative distances to the centres, each smoothed by a guided filter with the map as guide; a cell's raw
    label is its largest weight's, clusters being numbered from dark to light. Regions of the darkest whose area exceeds
    ``least_area`` are filled; the middle cluster is opened by an ellipse, and what that removes belongs to the lightest.
    ``raw`` and ``set`` are bitboards before and after that.
    """
    rows = maps.withColumn("_g", F.col(value)).withColumn("centres", centres("_g"))
    near = F.transform("_g", lambda x: F.transform("centres", lambda c: F.exp(-F.least(F.abs(x - c), F.lit(500.0)))))
    rows = rows.withColumn("_near", F.transform(near, lambda e: F.transform(e, lambda w: w / (e[0] + e[1] + e[2]))))
    place = lambda k: lambda e: e[k]
    rows = rows.withColumns({f"_w{k}": F.transform("_near", place(k)) for k in range(CLUSTERS)}).withColumn("_gg", F.transform("_g", lambda x: x * x))
    rows = rows.withColumns({f"_p{k}": F.zip_with("_g", f"_w{k}", lambda x, w: x * w) for k in range(CLUSTERS)})
    rows = box(rows, {"_mg": "_g", "_mgg": "_gg", **{f"_m{k}": f"_w{k}" for k in range(CLUSTERS)}, **{f"_q{k}": f"_p{k}" for k in range(CLUSTERS)}})
    rows = rows.withColumn("_var", F.zip_with("_mgg", "_mg", lambda s, m: s - m * m + GUIDED_EPS))
    rows = rows.withColumns({f"_a{k}": F.zip_with(F.zip_with(f"_q{k}", F.zip_with("_mg", f"_m{k}", lambda g, m: g * m), lambda q, x: q - x), "_var", lambda c, s: c / s) for k in range(CLUSTERS)})
    rows = rows.withColumns({f"_b{k}": F.zip_with(f"_m{k}", F.zip_with(f"_a{k}", "_mg", lambda a, g: a * g), lambda m, x: m - x) for k in range(CLUSTERS)})
    rows = box(rows, {f"_{x}{k}": f"_{x}{k}" for x in "ab" for k in range(CLUSTERS)})
    refined = F.arrays_zip(F.col("_g").alias("g"), *[F.col(f"_{x}{k}").alias(f"{x}{k}") for x in "ab" for k in range(CLUSTERS)])
    rows = rows.withColumn("weights", F.transform(refined, lambda t: F.array(*[t[f"a{k}"] * t["g"] + t[f"b{k}"] for k in range(CLUSTERS)])))
    pick = F.transform("weights", lambda w: F.array_position(w, F.array_max(w)).cast("int") - 1)
    rows = rows.withColumn("_pick", pick)
    # clusters from dark to light by the mean of their cells; one without cells counts as 0
    mean = lambda k: F.coalesce(F.aggregate(F.filter(F.arrays_zip(F.col("_pick").alias("p"), F.col("_g").alias("g")), lambda t: t["p"] == k), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda t, x: F.struct((t["s"] + x["g"]).alias("s"), (t["n"] + 1).alias("n")), lambda t: F.when(t["n"] > 0, t["s"] / t["n"])), F.lit(0.0))
    order = F.transform(F.array_sort(F.array(*[F.struct(mean(k).alias("m"), F.lit(k).alias("k")) for k in range(CLUSTERS)])), lambda t: t["k"])
    rows = rows.withColumn("_order", order)
    rows = rows.withColumns({f"raw{j}": bb.board(F.col("_pick"), lambda x, j=j: x == F.col("_order")[j]) for j in range(CLUSTERS)})
    rows = rows.withColumn("_solid", bb.large_filled(F.col("raw0"), least_area))
    rows = rows.withColumn("set0", bb.either(F.col("raw0"), F.col("_solid"))).withColumn("_middle", bb.without(F.col("raw1"), F.col("_solid")))
    rows = rows.withColumn("set1", bb.opened(F.col("_middle"), bb.ellipse(KERNEL)))
    rows = rows.withColumn("set2", F.bitwise_not(bb.either(F.col("set0"), F.col("set1"))))
    return rows.select(*maps.columns, "centres", "weights", *[f"raw{k}" for k in range(CLUSTERS)], *[f"set{k}" for k in range(CLUSTERS)])


def region_count(sets: list[str]) -> Column:
    """Regions of several clusters of a map, cells that touch at a corner being one."""
    return sum((F.size(bb.regions(F.col(s))) for s in sets[1:]), F.size(bb.regions(F.col(sets[0]))))
