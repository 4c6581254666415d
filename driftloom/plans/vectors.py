"""Queries of the vector and geometry family (J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.vectors import dot, mean_vector, norm, sq_dist, sum_vector, unit
from driftloom.plans.base import DIM, clean_bank, paired, records, rounded, shifted_bank, sql_mean, sql_unit, with_clean, with_rec, with_units
from driftloom.registry import query

KEY = ["dataset", "backbone", "tag"]


@query("j2_feature_drift", with_units("SELECT dataset, backbone, tag, count(*) AS n, round(greatest(avg(1 - cos), 0.0), 6) AS drift FROM pairs GROUP BY dataset, backbone, tag"))
def feature_drift(spark: SparkSession, d: str) -> DataFrame:
    return paired(spark, d).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), rounded(F.greatest(F.avg(1 - F.col("cos")), F.lit(0.0))).alias("drift"))


@query("rec_condition_records", with_rec("SELECT * FROM rec"))
def condition_records(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d)


@query("j1_l2_normalize", with_clean(f"SELECT dataset, backbone, vec_id, round(list_dot_product(u, u), 6) AS sq_norm, round(u[1], 6) AS first, round(n8, 6) AS plus_eps FROM (SELECT *, {sql_unit('x')} AS u, x[1] / (sqrt(list_dot_product(x, x)) + 1e-8) AS n8 FROM clean)"))
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return clean_bank(spark, d).select("dataset", "backbone", "vec_id", unit(x).alias("u"), (x[0] / (norm(x) + 1e-8)).alias("e")).select("dataset", "backbone", "vec_id", rounded(dot(F.col("u"), F.col("u"), DIM)).alias("sq_norm"), rounded(F.col("u")[0]).alias("first"), rounded(F.col("e")).alias("plus_eps"))


@query("j3_sample_drift", with_units("SELECT dataset, backbone, tag, vec_id, round(1 - list_dot_product(u, c), 6) AS drift FROM pairs"))
def sample_drift(spark: SparkSession, d: str) -> DataFrame:
    return paired(spark, d).select(*KEY, "vec_id", rounded(1 - dot(F.col("u"), F.col("c"), DIM)).alias("drift"))


def _units(spark: SparkSession, d: str) -> DataFrame:
    return shifted_bank(spark, d).select(*KEY, "perturbation", "vec_id", "label", unit(F.col("x")).alias("u"))


def centroids(units: DataFrame) -> DataFrame:
    """Mean, then normalise, for each key and label."""
    return units.groupBy(*KEY, "label").agg(F.count(F.lit(1)).alias("n"), unit(mean_vector(F.col("u"), DIM)).alias("c"))


CENT = f", cent AS (SELECT dataset, backbone, tag, label, n, {sql_unit('m')} AS c FROM (SELECT dataset, backbone, tag, label, count(*) AS n, {sql_mean('u')} AS m FROM su GROUP BY dataset, backbone, tag, label))"
GEO = (
    CENT
    + """, intra AS (SELECT s.dataset, s.backbone, s.tag, avg(1 - list_dot_product(s.u, k.c)) AS intra FROM su s JOIN cent k ON s.dataset = k.dataset AND s.backbone = k.backbone AND s.tag = k.tag AND s.label = k.label WHERE k.n >= 2 GROUP BY ALL),
inter AS (SELECT a.dataset, a.backbone, a.tag, avg(1 - list_dot_product(a.c, b.c)) AS inter FROM cent a JOIN cent b ON a.dataset = b.dataset AND a.backbone = b.backbone AND a.tag = b.tag AND a.label < b.label GROUP BY ALL),
geo AS (SELECT i.dataset, i.backbone, i.tag, intra, inter, intra / greatest(inter, 1e-12) AS fgcs, inter / greatest(intra, 1e-12) AS fsr FROM intra i JOIN inter e ON i.dataset = e.dataset AND i.backbone = e.backbone AND i.tag = e.tag)
"""
)


@query("j4_class_centroids", with_units("SELECT 1")[: -len("\nSELECT 1")] + CENT + " SELECT dataset, backbone, tag, label, n, round(c[1], 6) AS c1, round(c[16], 6) AS c16 FROM cent")
def class_centroids(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c")
    return centroids(_units(spark, d)).select(*KEY, "label", "n", rounded(c[0]).alias("c1"), rounded(c[DIM - 1]).alias("c16"))


def _geometry(spark: SparkSession, d: str) -> DataFrame:
    units = _units(spark, d)
    cent = centroids(units)
    intra = units.join(cent.filter("n >= 2"), [*KEY, "label"]).groupBy(*KEY).agg(F.avg(1 - dot(F.col("u"), F.col("c"), DIM)).alias("intra"))
    a, b = cent.select(*KEY, "label", "c"), cent.select(*KEY, F.col("label").alias("label2"), F.col("c").alias("c2"))
    inter = a.join(b, KEY).filter("label < label2").groupBy(*KEY).agg(F.avg(1 - dot(F.col("c"), F.col("c2"), DIM)).alias("inter"))
    ratio = lambda x, y: F.col(x) / F.greatest(F.col(y), F.lit(1e-12))
    return intra.join(inter, KEY).withColumns({"fgcs": ratio("intra", "inter"), "fsr": ratio("inter", "intra")})


_geo = with_units("SELECT 1")[: -len("\nSELECT 1")] + GEO


@query("j5_intra_class_variance", _geo + "SELECT dataset, backbone, tag, round(intra, 6) AS intra FROM geo")
def intra_class(spark: SparkSession, d: str) -> DataFrame:
    return _geometry(spark, d).select(*KEY, rounded(F.col("intra")).alias("intra"))


@query("j6_inter_class_distance", _geo + "SELECT dataset, backbone, tag, round(inter, 6) AS inter FROM geo")
def inter_class(spark: SparkSession, d: str) -> DataFrame:
    return _geometry(spark, d).select(*KEY, rounded(F.col("inter")).alias("inter"))


@query("j7_fgcs_fsr", _geo + "SELECT dataset, backbone, tag, round(fgcs, 6) AS fgcs, round(fsr, 6) AS fsr FROM geo")
def fgcs_fsr(spark: SparkSession, d: str) -> DataFrame:
    return _geometry(spark, d).select(*KEY, rounded(F.col("fgcs")).alias("fgcs"), rounded(F.col("fsr")).alias("fsr"))


_deltas = ", ".join(f"round(s.{c} - k.{c}, 6) AS delta_{c}" for c in ("intra", "inter", "fgcs", "fsr"))


@query("j8_geometry_deltas", _geo + f"SELECT s.dataset, s.backbone, s.tag, {_deltas} FROM geo s JOIN geo k ON s.dataset = k.dataset AND s.backbone = k.backbone AND k.tag = 'clean_0' WHERE s.tag <> 'clean_0'")
def geometry_deltas(spark: SparkSession, d: str) -> DataFrame:
    geo = _geometry(spark, d)
    names = ("intra", "inter", "fgcs", "fsr")
    clean = geo.filter("tag = 'clean_0'").select("dataset", "backbone", *[F.col(c).alias(f"k_{c}") for c in names])
    return geo.filter("tag <> 'clean_0'").join(clean, ["dataset", "backbone"]).select(*KEY, *[rounded(F.col(c) - F.col(f"k_{c}")).alias(f"delta_{c}") for c in names])


@query("j9_class_centroid_drift", with_units("SELECT 1")[: -len("\nSELECT 1")] + CENT + " SELECT a.backbone, a.dataset AS source, b.dataset AS target, count(*) AS classes, round(avg(1 - list_dot_product(a.c, b.c)), 6) AS centroid_drift FROM cent a JOIN cent b ON a.backbone = b.backbone AND a.label = b.label AND a.tag = 'clean_0' AND b.tag = 'clean_0' AND a.dataset <> b.dataset GROUP BY ALL")
def class_centroid_drift(spark: SparkSession, d: str) -> DataFrame:
    cent = centroids(_units(spark, d).filter("perturbation = 'clean'"))
    a, b = cent.select("backbone", "label", F.col("dataset").alias("source"), "c"), cent.select("backbone", "label", F.col("dataset").alias("target"), F.col("c").alias("c2"))
    both = a.join(b, ["backbone", "label"]).filter("source <> target")
    return both.groupBy("backbone", "source", "target").agg(F.count(F.lit(1)).alias("classes"), rounded(F.avg(1 - dot(F.col("c"), F.col("c2"), DIM))).alias("centroid_drift"))


@query("j10_batch_centroid_cosine", with_rec("SELECT dataset, backbone, tag, round(centroid, 6) AS ref_centroid_cosine FROM rec"))
def batch_centroid(spark: SparkSession, d: str) -> DataFrame:
    both = paired(spark, d).filter("perturbation <> 'clean'").groupBy(*KEY).agg(unit(mean_vector(F.col("u"), DIM)).alias("a"), unit(mean_vector(F.col("c"), DIM)).alias("b"))
    return both.select(*KEY, rounded(1 - dot(F.col("a"), F.col("b"), DIM)).alias("ref_centroid_cosine"))


@query("j11_within_batch_spread", with_units("SELECT a.dataset, a.backbone, a.tag, round(1 - avg(list_dot_product(a.u, b.u)), 6) AS spread FROM su a JOIN su b ON a.dataset = b.dataset AND a.backbone = b.backbone AND a.tag = b.tag AND a.vec_id < b.vec_id GROUP BY ALL"))
def within_batch_spread(spark: SparkSession, d: str) -> DataFrame:
    """From the sum of unit vectors alone; no pair is formed."""
    s = _units(spark, d).groupBy(*KEY).agg(F.count(F.lit(1)).cast("double").alias("n"), sum_vector(F.col("u"), DIM).alias("s"), F.sum(dot(F.col("u"), F.col("u"), DIM)).alias("own"))
    return s.filter("n > 1").select(*KEY, rounded(1 - (dot(F.col("s"), F.col("s"), DIM) - F.col("own")) / (F.col("n") * (F.col("n") - 1))).alias("spread"))


_D2 = "sqrt(greatest(list_dot_product(a.c, a.c) + list_dot_product(b.c, b.c) - 2 * list_dot_product(a.c, b.c), 0.0))"


@query("j12_centroid_distances", with_units("SELECT 1")[: -len("\nSELECT 1")] + f", mc AS (SELECT backbone, dataset, label, {sql_mean('u')} AS c FROM su WHERE tag = 'clean_0' GROUP BY ALL), w AS (SELECT a.backbone, avg({_D2}) AS species FROM mc a JOIN mc b ON a.backbone = b.backbone AND a.dataset = b.dataset AND a.label < b.label GROUP BY ALL), s AS (SELECT a.backbone, avg({_D2}) AS source FROM mc a JOIN mc b ON a.backbone = b.backbone AND a.label = b.label AND a.dataset < b.dataset GROUP BY ALL) SELECT w.backbone, round(species, 6) AS between_species, round(source, 6) AS between_source, round(source / species, 6) AS ratio FROM w JOIN s ON w.backbone = s.backbone")
def centroid_distances(spark: SparkSession, d: str) -> DataFrame:
    cent = _units(spark, d).filter("perturbation = 'clean'").groupBy("backbone", "dataset", "label").agg(mean_vector(F.col("u"), DIM).alias("c"))
    other = cent.select("backbone", F.col("dataset").alias("dataset2"), F.col("label").alias("label2"), F.col("c").alias("c2"))
    far = F.sqrt(sq_dist(F.col("c"), F.col("c2"), DIM))
    both = cent.join(other, "backbone").filter("(dataset = dataset2 AND label < label2) OR (label = label2 AND dataset < dataset2)")
    two = both.groupBy("backbone").agg(F.avg(F.when(F.col("dataset") == F.col("dataset2"), far)).alias("species"), F.avg(F.when(F.col("dataset") != F.col("dataset2"), far)).alias("source"))
    return two.select("backbone", rounded(F.col("species")).alias("between_species"), rounded(F.col("source")).alias("between_source"), rounded(F.col("source") / F.col("species")).alias("ratio"))


@query("j13_pooled_centroid", with_clean(f"SELECT vec_id, round(p[1], 6) AS p1, round(p[16], 6) AS p16 FROM (SELECT vec_id, {sql_mean('x')} AS p FROM clean GROUP BY vec_id)"))
def pooled_centroid(spark: SparkSession, d: str) -> DataFrame:
    """The four slices of a vector as tokens of a map, averaged."""
    p = clean_bank(spark, d).groupBy("vec_id").agg(mean_vector(F.col("x"), DIM).alias("p"))
    return p.select("vec_id", rounded(F.col("p")[0]).alias("p1"), rounded(F.col("p")[DIM - 1]).alias("p16"))


@query("j14_squared_distance", with_units("SELECT dataset, backbone, tag, round(avg(greatest(list_dot_product(u, u) + list_dot_product(c, c) - 2 * list_dot_product(u, c), 0.0)), 6) AS mean_sq FROM pairs GROUP BY ALL"))
def squared_distance(spark: SparkSession, d: str) -> DataFrame:
    return paired(spark, d).groupBy(*KEY).agg(rounded(F.avg(sq_dist(F.col("u"), F.col("c"), DIM))).alias("mean_sq"))


