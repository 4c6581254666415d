"""Queries of the label-map family (P) and of the perturbations that are expressions (Q), on maps made from the embeddings.

A vector of 64 numbers is an 8 x 8 map: a cell's cluster is by thresholds on its value, its activation the value's
magnitude. The perturbed map is that of the next vector of the same label mod 3 (by id), so that pairs are not alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions import bitboards
from driftloom.functions.vectors import as_double
from driftloom.operators.label_maps import region_count
from driftloom.plans.base import rounded
from driftloom.registry import query
from driftloom.sources.store import table

CLUSTERS = 3


def cells(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, pos, a (cluster), b (cluster after the shift), cam, cam2: one row for each cell of each map."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(as_double(F.col("embedding"))).alias("pos", "v"))
    cluster = lambda v: F.when(v < -0.05, 0).when(v < 0.05, 1).otherwise(2)
    w = F.col("v") + F.when(F.col("pos") % 3 == 0, 0.08).otherwise(0.0)
    return e.select("vec_id", "pos", cluster(F.col("v")).alias("a"), cluster(w).alias("b"), F.abs("v").alias("cam"), F.abs(w).alias("cam2"))


CELLS = """WITH e AS (SELECT vec_id, i AS pos, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) r(i)), f AS (SELECT *, v + CASE WHEN pos % 3 = 0 THEN 0.08 ELSE 0 END AS w FROM e),
cells AS (SELECT vec_id, pos, CASE WHEN v < -0.05 THEN 0 WHEN v < 0.05 THEN 1 ELSE 2 END AS a, CASE WHEN w < -0.05 THEN 0 WHEN w < 0.05 THEN 1 ELSE 2 END AS b, abs(v) AS cam, abs(w) AS cam2 FROM f)
"""
IOU = CELLS + """, iou AS (SELECT vec_id, i, j, CASE WHEN count_if(a = i OR b = j) = 0 THEN 1.0 ELSE count_if(a = i AND b = j) / count_if(a = i OR b = j) END AS iou FROM cells, range(3) x(i), range(3) y(j) GROUP BY ALL)
"""


def iou_matrix(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, m00 ... m22: the IoU of every cluster pair, from one aggregate over a map's cells."""
    a, b = F.col("a"), F.col("b")
    cols = []
    for i in range(CLUSTERS):
        for j in range(CLUSTERS):
            either = F.count_if((a == i) | (b == j))
            cols.append(F.when(either == 0, 1.0).otherwise(F.count_if((a == i) & (b == j)) / either).alias(f"m{i}{j}"))
    return cells(spark, d).groupBy("vec_id").agg(*cols)


@query("p1_csi", IOU + "SELECT vec_id, round(avg(iou), 6) AS csi FROM iou WHERE i = j GROUP BY vec_id")
def csi(spark: SparkSession, d: str) -> DataFrame:
    return iou_matrix(spark, d).select("vec_id", rounded((F.col("m00") + F.col("m11") + F.col("m22")) / 3).alias("csi"))


_PERM = ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))


@query("p2_hungarian_csi", IOU + "SELECT vec_id, round(greatest(" + ", ".join("(" + " + ".join(f"max(iou) FILTER (i = {i} AND j = {j})" for i, j in enumerate(p)) + ") / 3" for p in _PERM) + "), 6) AS csi_hungarian, round(greatest(" + ", ".join("(" + " + ".join(f"max(iou) FILTER (i = {i} AND j = {j})" for i, j in enumerate(p)) + ") / 3" for p in _PERM) + ") - avg(iou) FILTER (i = j), 6) AS permutation_gap FROM iou GROUP BY vec_id")
def hungarian_csi(spark: SparkSession, d: str) -> DataFrame:
    """The best assignment of three clusters is the best of six."""
    m = iou_matrix(spark, d)
    each = [(F.col(f"m0{p[0]}") + F.col(f"m1{p[1]}") + F.col(f"m2{p[2]}")) / 3 for p in _PERM]
    return m.select("vec_id", rounded(F.greatest(*each)).alias("csi_hungarian"), rounded(F.greatest(*each) - each[0]).alias("permutation_gap"))


@query("p3_cluster_csi", IOU + "SELECT i::INT AS cluster, round(avg(iou), 6) AS csi FROM iou WHERE i = j GROUP BY i")
def cluster_csi(spark: SparkSession, d: str) -> DataFrame:
    long = iou_matrix(spark, d).select(F.explode(F.array(*[F.struct(F.lit(i).alias("cluster"), F.col(f"m{i}{i}").alias("iou")) for i in range(CLUSTERS)])).alias("x"))
    return long.groupBy("x.cluster").agg(rounded(F.avg("x.iou")).alias("csi"))


_REACH = """, sets AS (SELECT vec_id, pos, a AS k FROM cells),
reach AS (WITH RECURSIVE r(vec_id, k, pos, least) AS (SELECT vec_id, k, pos, pos FROM sets UNION SELECT r.vec_id, r.k, s.pos, r.least FROM r JOIN sets s ON s.vec_id = r.vec_id AND s.k = r.k AND abs(s.pos // 8 - r.pos // 8) <= 1 AND abs(s.pos % 8 - r.pos % 8) <= 1 WHERE s.pos > r.least) SELECT vec_id, k, pos, min(least) AS region FROM r GROUP BY ALL)"""


@query("p4_sgi", CELLS + _REACH + " SELECT vec_id, round(count(DISTINCT k * 64 + region) / 64, 6) AS sgi FROM (SELECT a.vec_id, a.k, min(a.region) AS region, a.pos FROM reach a GROUP BY ALL) GROUP BY vec_id")
def sgi(spark: SparkSession, d: str) -> DataFrame:
    """8-connected regions of all clusters, for each cell of a map, by flood fills of bitboards: no Python worker, no shuffle."""
    e = table(spark, d, "embeddings").select("vec_id", as_double(F.col("embedding")).alias("v"))
    tests = (lambda x: x < -0.05, lambda x: (x >= -0.05) & (x < 0.05), lambda x: x >= 0.05)
    boards = e.select("vec_id", *[bitboards.board(F.col("v"), t).alias(f"m{k}") for k, t in enumerate(tests)])
    return boards.select("vec_id", rounded(region_count(["m0", "m1", "m2"]) / 64.0).alias("sgi"))


def components(labels: np.ndarray) -> int:
    """Number of 8-connected regions of equal labels: every cell takes the smallest place it can reach."""
    h, w = labels.shape
    place = np.arange(h * w).reshape(h, w)
    while True:
        before = place.copy()
        for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)):
            a = (slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
            b = (slice(dy, h), slice(max(0, dx), w - max(0, -dx)))
            same = labels[a] == labels[b]
            low = np.minimum(place[a], place[b])
            place[a] = np.where(same, low, place[a])
            place[b] = np.where(same, np.minimum(place[b], low), place[b])
        if (place == before).all():
            return len(np.unique(place))


@query("p5_adjusted_rand", CELLS + """, t AS (SELECT vec_id, a, b, count(*) AS n FROM cells GROUP BY ALL), s AS (SELECT vec_id, sum(n * (n - 1) / 2) AS ij FROM t GROUP BY vec_id),
ra AS (SELECT vec_id, sum(n * (n - 1) / 2) AS x FROM (SELECT vec_id, a, sum(n) AS n FROM t GROUP BY ALL) GROUP BY vec_id), rb AS (SELECT vec_id, sum(n * (n - 1) / 2) AS y FROM (SELECT vec_id, b, sum(n) AS n FROM t GROUP BY ALL) GROUP BY vec_id)
SELECT s.vec_id, round(CASE WHEN (x + y) / 2 = x * y / 2016 THEN 1 ELSE (ij - x * y / 2016) / ((x + y) / 2 - x * y / 2016) END, 6) AS ari FROM s JOIN ra ON s.vec_id = ra.vec_id JOIN rb ON s.vec_id = rb.vec_id""")
def adjusted_rand(spark: SparkSession, d: str) -> DataFrame:
    """From the contingency counts of a map, all in one aggregate."""
    a, b = F.col("a"), F.col("b")
    pairs = lambda c: c * (c - 1) / 2
    cell = [F.count_if((a == i) & (b == j)) for i in range(CLUSTERS) for j in range(CLUSTERS)]
    ra, rb = [F.count_if(a == i) for i in range(CLUSTERS)], [F.count_if(b == i) for i in range(CLUSTERS)]
    s = cells(spark, d).groupBy("vec_id").agg(sum(map(pairs, cell), F.lit(0)).alias("ij"), sum(map(pairs, ra), F.lit(0)).alias("x"), sum(map(pairs, rb), F.lit(0)).alias("y"), F.count("*").alias("n"))
    chance = F.col("x") * F.col("y") / pairs(F.col("n"))
    top = (F.col("x") + F.col("y")) / 2
    return s.select("vec_id", rounded(F.when(top == chance, 1.0).otherwise((F.col("ij") - chance) / (top - chance))).alias("ari"))


@query("p7_nearest_downsample", "SELECT vec_id, i AS pos, CASE WHEN v < -0.05 THEN 0 WHEN v < 0.05 THEN 1 ELSE 2 END AS cluster FROM (SELECT vec_id, i, CAST(embedding[(i // 4) * 2 * 8 + (i % 4) * 2 + 1] AS DOUBLE) AS v FROM embeddings, range(16) r(i))")
def nearest_downsample(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).filter((F.floor(F.col("pos") / 8) % 2 == 0) & (F.col("pos") % 2 == 0))
    return c.select("vec_id", (F.floor(F.col("pos") / 16) * 4 + F.floor(F.col("pos") % 8 / 2)).alias("pos"), F.col("a").alias("cluster"))


def _mass(cam: str) -> list[Column]:
    total = F.sum(cam)
    return [F.when(total < 1e-10, 1 / CLUSTERS).otherwise(F.coalesce(F.sum(F.when(F.col("a") == i, F.col(cam))), F.lit(0.0)) / total) for i in range(CLUSTERS)]


MASS = CELLS + ", mass AS (SELECT vec_id, k, CASE WHEN sum(cam) < 1e-10 THEN 1 / 3 ELSE coalesce(sum(cam) FILTER (a = k), 0) / sum(cam) END AS p, CASE WHEN sum(cam2) < 1e-10 THEN 1 / 3 ELSE coalesce(sum(cam2) FILTER (a = k), 0) / sum(cam2) END AS q FROM cells, range(3) r(k) GROUP BY ALL), nm AS (SELECT vec_id, k, greatest(p, 1e-10) / sum(greatest(p, 1e-10)) OVER (PARTITION BY vec_id) AS p, greatest(q, 1e-10) / sum(greatest(q, 1e-10)) OVER (PARTITION BY vec_id) AS q FROM mass)\n"


def masses(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, p, q: a map's activation by cluster, before and after the shift."""
    return cells(spark, d).groupBy("vec_id").agg(F.array(*_mass("cam")).alias("p"), F.array(*_mass("cam2")).alias("q"))


def smoothed(p: Column) -> Column:
    up = F.transform(p, lambda x: F.greatest(x, F.lit(1e-10)))
    total = F.aggregate(up, F.lit(0.0), lambda s, x: s + x)
    return F.transform(up, lambda x: x / total)


def folded(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


@query("p8_cam_mass", MASS + "SELECT vec_id, " + ", ".join(f"round(max(p) FILTER (k = {k}), 6) AS c{k}" for k in range(3)) + " FROM mass GROUP BY vec_id")
def cam_mass(spark: SparkSession, d: str) -> DataFrame:
    return masses(spark, d).select("vec_id", *[rounded(F.col("p")[k]).alias(f"c{k}") for k in range(CLUSTERS)])


@query("p9_js_distance", MASS + "SELECT vec_id, round(sqrt(greatest(sum(p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2, 0)), 5) AS js_distance, round(greatest(sum(p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2, 0), 6) AS js_divergence FROM nm GROUP BY vec_id")
def js_distance(spark: SparkSession, d: str) -> DataFrame:
    half = lambda x, m: x * F.log2(x / m)
    terms = F.zip_with("p", "q", lambda p, q: half(p, (p + q) / 2) + half(q, (p + q) / 2))
    m = masses(spark, d).select("vec_id", smoothed(F.col("p")).alias("p"), smoothed(F.col("q")).alias("q")).select("vec_id", F.greatest(folded(terms) / 2, F.lit(0.0)).alias("js"))
    return m.select("vec_id", rounded(F.sqrt("js"), 5).alias("js_distance"), rounded(F.col("js")).alias("js_divergence"))


@query("p10_entropy", MASS + "SELECT vec_id, round(-sum(p * log2(p)), 6) AS entropy FROM nm GROUP BY vec_id")
def entropy(spark: SparkSession, d: str) -> DataFrame:
    return masses(spark, d).select("vec_id", smoothed(F.col("p")).alias("p")).select("vec_id", rounded(-folded(F.transform("p", lambda x: x * F.log2(x)))).alias("entropy"))


_TOK = "WITH e AS (SELECT vec_id, label, t, CAST(embedding AS DOUBLE[])[t * 16 + 1 : t * 16 + 16] AS x FROM embeddings, range(4) r(t)), c AS (SELECT label, [" + ", ".join(f"avg(x[{i}])" for i in range(1, 17)) + "] AS c FROM e GROUP BY label), s AS (SELECT e.vec_id, e.t, greatest(list_cosine_similarity(e.x, c.c), 0) AS s FROM e JOIN c ON e.label = c.label), r AS (SELECT *, min(s) OVER w AS lo, max(s) OVER w AS hi FROM s WINDOW w AS (PARTITION BY vec_id)) SELECT vec_id, t::INT AS token, round(CASE WHEN hi - lo < 1e-10 THEN 0 ELSE (s - lo) / (hi - lo) END, 5) AS cam FROM r"


@query("p11_centroid_cam", _TOK)
def centroid_cam(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of each token to its class's centroid, cut at 0 and scaled to a map's range."""
    from pyspark.sql import Window

    from driftloom.functions.vectors import dot, mean_vector, unit

    e = table(spark, d, "embeddings").select("vec_id", "label", as_double(F.col("embedding")).alias("e"))
    tokens = e.select("vec_id", "label", F.posexplode(F.array(*[F.slice("e", t * 16 + 1, 16) for t in range(4)])).alias("token", "x"))
    cent = tokens.groupBy("label").agg(unit(mean_vector(F.col("x"), 16)).alias("c"))
    s = tokens.join(cent, "label").select("vec_id", "token", F.greatest(dot(unit(F.col("x")), F.col("c"), 16), F.lit(0.0)).alias("s"))
    w = Window.partitionBy("vec_id")
    lo, hi = F.min("s").over(w), F.max("s").over(w)
    return s.select("vec_id", "token", rounded(F.when(hi - lo < 1e-10, 0.0).otherwise((F.col("s") - lo) / (hi - lo)), 5).alias("cam"))


_PITCHES = ((8, 6), (8, 4), (6, 4))


def overlap_weights(p: int, q: int) -> list[tuple[int, int, int]]:
    """(cell of a p x p grid, cell of a q x q grid, their shared area) over one square, in units of 1 / (p q)^2."""
    along = [(i, j, min((i + 1) * q, (j + 1) * p) - max(i * q, j * p)) for i in range(p) for j in range(q) if min((i + 1) * q, (j + 1) * p) > max(i * q, j * p)]
    return [(y * p + x, v * q + u, h * w) for y, v, h in along for x, u, w in along]


_CROSS = """WITH e AS (SELECT vec_id, i AS pos, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) r(i)), f AS (SELECT vec_id, pos, CASE WHEN v < -0.05 THEN 0 WHEN v < 0.05 THEN 1 ELSE 2 END AS a, CASE WHEN v + CASE WHEN pos % 3 = 0 THEN 0.08 ELSE 0 END < -0.05 THEN 0 WHEN v + CASE WHEN pos % 3 = 0 THEN 0.08 ELSE 0 END < 0.05 THEN 1 ELSE 2 END AS b FROM e),
pt AS (SELECT * FROM (VALUES (8, 6), (8, 4), (6, 4)) t(p, q)), al AS (SELECT p, q, i, j, least((i + 1) * q, (j + 1) * p) - greatest(i * q, j * p) AS w FROM pt, range(8) x(i), range(8) y(j) WHERE i < p AND j < q AND least((i + 1) * q, (j + 1) * p) > greatest(i * q, j * p)),
ow AS (SELECT m.p, m.q, m.i * m.p + n.i AS ca, m.j * m.q + n.j AS cb, m.w * n.w AS w FROM al m JOIN al n ON m.p = n.p AND m.q = n.q),
pr AS (SELECT s.vec_id, ow.p, ow.q, s.a, t.b, sum(w) AS w FROM ow JOIN f s ON s.pos = ow.ca JOIN f t ON t.pos = ow.cb AND t.vec_id = s.vec_id GROUP BY ALL),
iou AS (SELECT vec_id, p, q, i, j, CASE WHEN coalesce(sum(w) FILTER (a = i OR b = j), 0) = 0 THEN 1.0 ELSE coalesce(sum(w) FILTER (a = i AND b = j), 0) / sum(w) FILTER (a = i OR b = j) END AS iou FROM pr, range(3) x(i), range(3) y(j) GROUP BY ALL)
"""


@query("p13_cross_pitch", _CROSS + "SELECT vec_id, p::INT AS pitch_a, q::INT AS pitch_b, round(avg(iou) FILTER (i = j), 6) AS csi, round(greatest(" + ", ".join("(" + " + ".join(f"max(iou) FILTER (i = {i} AND j = {j})" for i, j in enumerate(p)) + ") / 3" for p in _PERM) + "), 6) AS csi_hungarian, round(greatest(" + ", ".join("(" + " + ".join(f"max(iou) FILTER (i = {i} AND j = {j})" for i, j in enumerate(p)) + ") / 3" for p in _PERM) + ") - avg(iou) FILTER (i = j), 6) AS permutation_gap FROM iou GROUP BY ALL")
def cross_pitch(spark: SparkSession, d: str) -> DataFrame:
    """Stability of label maps between grids of different pitch over one square: cells meet by the area they share, then the best assignment of clusters.

    Map a is on the coarser side of no pair; the grid of pitch p holds the first p * p cells. Weights are three small fixed tables.
    """
    e = table(spark, d, "embeddings").select("vec_id", as_double(F.col("embedding")).alias("v"))
    cut = lambda x: F.when(x < -0.05, 0).when(x < 0.05, 1).otherwise(2)
    maps_ = e.select("vec_id", F.transform("v", cut).alias("a"), F.transform("v", lambda x, i: cut(x + F.when(i % 3 == 0, 0.08).otherwise(0.0))).alias("b"))
    weights = spark.createDataFrame([(p, q, *w) for p, q in _PITCHES for w in overlap_weights(p, q)], "pitch_a int, pitch_b int, ca int, cb int, w int")
    cells_ = maps_.crossJoin(F.broadcast(weights)).select("vec_id", "pitch_a", "pitch_b", F.get("a", F.col("ca")).alias("a"), F.get("b", F.col("cb")).alias("b"), "w")
    a, b, w = F.col("a"), F.col("b"), F.col("w")
    cols = []
    for i in range(CLUSTERS):
        for j in range(CLUSTERS):
            both, either = (F.sum(F.when(c, w).otherwise(0)) for c in ((a == i) & (b == j), (a == i) | (b == j)))
            cols.append(F.when(either == 0, 1.0).otherwise(F.try_divide(both, either)).alias(f"m{i}{j}"))
    m = cells_.groupBy("vec_id", "pitch_a", "pitch_b").agg(*cols)
    each = [(F.col(f"m0{p[0]}") + F.col(f"m1{p[1]}") + F.col(f"m2{p[2]}")) / 3 for p in _PERM]
    return m.select("vec_id", "pitch_a", "pitch_b", rounded(each[0]).alias("csi"), rounded(F.greatest(*each)).alias("csi_hungarian"), rounded(F.greatest(*each) - each[0]).alias("permutation_gap"))


def _image(spark: SparkSession, d: str) -> DataFrame:
    """A vector's first 48 numbers as a 3 x 16 image in [0, 1]: vec_id, channel, pos, v."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.slice(as_double(F.col("embedding")), 1, 48)).alias("i", "x"))
    return e.select("vec_id", F.floor(F.col("i") / 16).alias("channel"), (F.col("i") % 16).alias("pos"), F.greatest(F.least(F.col("x") + 0.5, F.lit(1.0)), F.lit(0.0)).alias("v"))


_IMG = "WITH img AS (SELECT vec_id, i // 16 AS channel, i % 16 AS pos, greatest(least(CAST(embedding[i + 1] AS DOUBLE) + 0.5, 1.0), 0.0) AS v FROM embeddings, range(48) r(i)) "


@query("q1_channel_shift", _IMG + "SELECT vec_id, channel, round(avg(greatest(least(v + CASE WHEN channel = 0 THEN 20 / 255.0::DOUBLE ELSE 0 END, 1), 0)), 6) AS mean FROM img GROUP BY ALL")
def channel_shift(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v") + F.when(F.col("channel") == 0, 20 / 255).otherwise(0.0)
    return _image(spark, d).groupBy("vec_id", "channel").agg(rounded(F.avg(F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0)))).alias("mean"))


@query("q5_brightness", _IMG + "SELECT vec_id, round(avg(greatest(least(v * 1.5, 1), 0)), 6) AS mean FROM img GROUP BY ALL")
def brightness(spark: SparkSession, d: str) -> DataFrame:
    return _image(spark, d).groupBy("vec_id").agg(rounded(F.avg(F.greatest(F.least(F.col("v") * 1.5, F.lit(1.0)), F.lit(0.0)))).alias("mean"))


@query("q11_contrast", _IMG + "SELECT vec_id, round(avg(greatest(least((v - m) * 0.5 + m, 1), 0)), 6) AS mean, round(max(greatest(least((v - m) * 0.5 + m, 1), 0)), 6) AS most FROM (SELECT *, avg(v) OVER (PARTITION BY vec_id) AS m FROM img) GROUP BY vec_id")
def contrast(spark: SparkSession, d: str) -> DataFrame:
    m = _image(spark, d).groupBy("vec_id").agg(F.avg("v").alias("m"))
    v = F.greatest(F.least((F.col("v") - F.col("m")) * 0.5 + F.col("m"), F.lit(1.0)), F.lit(0.0))
    return _image(spark, d).join(m, "vec_id").groupBy("vec_id").agg(rounded(F.avg(v)).alias("mean"), rounded(F.max(v)).alias("most"))


@query("l12_psnr", _IMG + "SELECT vec_id, round(-10 * log10(1 / greatest(avg(power(v - greatest(least(v + 0.1, 1), 0), 2)), 1e-12)), 5) AS neg_psnr FROM img GROUP BY vec_id")
def psnr(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("v") - F.greatest(F.least(F.col("v") + 0.1, F.lit(1.0)), F.lit(0.0))
    return _image(spark, d).groupBy("vec_id").agg(rounded(-10 * F.log10(1 / F.greatest(F.avg(e * e), F.lit(1e-12))), 5).alias("neg_psnr"))
