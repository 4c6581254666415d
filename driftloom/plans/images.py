"""Queries of the image layer that array libraries can express (Q, P6, P12-P16) and of probes by Spark's own learners (K15, K16, P14)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.functions import bitboards, images
from driftloom.functions.vectors import as_double, dot, sum_vector, unit
from driftloom.operators import label_maps, probes
from driftloom.plans.base import DIM, clean_bank, correlation, paired, records, rounded, shifted_bank, with_clean, with_rec, with_units
from driftloom.plans import maps
from driftloom.registry import oracle, query
from driftloom.sources.ledger import Ledger
from driftloom.sources.store import fresh_folder, once, table, written

SHAPE = (3, 4, 4)
#: A severity of each perturbation.
GRID = (("red_channel_shift", "20"), ("green_channel_shift", "20"), ("blue_channel_shift", "20"), ("resize", "2.0"), ("gaussian_blur", "1.0"), ("rotation", "90"), ("illumination", "0.5"), ("gaussian_noise", "0.05"), ("shot_noise", "60"), ("impulse_noise", "0.1"), ("motion_blur", "3"), ("zoom_blur", "0.2"), ("contrast", "0.5"), ("pixelate", "0.5"), ("scratch", "2"), ("defocus_blur", "1"), ("jpeg", "30"), ("illumination_correction", "1"), ("compound", "mild"), ("compound", "severe"))


def image_rows(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, pixels: the first 48 numbers of a vector, moved into [0, 1]."""
    x = F.transform(F.slice(as_double(F.col("embedding")), 1, 48), lambda v: F.greatest(F.least(v + 0.5, F.lit(1.0)), F.lit(0.0)))
    return table(spark, d, "embeddings").select("vec_id", x.alias("pixels"))


@query("q_perturbations")
def perturbations(spark: SparkSession, d: str) -> DataFrame:
    """Every perturbation of every image: mean value and mean absolute change; noise is seeded by the image's id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [(n, v, images.make(n, v)) for n, v in GRID]
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, *SHAPE)
            out: dict[str, list] = {k: [] for k in ("vec_id", "perturbation", "severity", "mean", "change")}
            for i, im in zip(batch.column(0).to_pylist(), x, strict=True):
                for n, v, f in made:
                    y = f(im, i)
                    for k, value in zip(out, (i, n, v, float(y.mean()), float(np.abs(y - im).mean())), strict=True):
                        out[k].append(value)
            yield pa.RecordBatch.from_pydict(out)

    found = image_rows(spark, d).mapInArrow(run, "vec_id long, perturbation string, severity string, mean double, change double")
    return found.select("vec_id", "perturbation", "severity", rounded(F.col("mean")).alias("mean"), rounded(F.col("change")).alias("change"))


@query("l12_ssim")
def ssim_detector(spark: SparkSession, d: str) -> DataFrame:
    """1 - SSIM of each image and its brightened form."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, *SHAPE)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "score": [1 - images.ssim(im, images.brightness(im, 1.2)) for im in x]})

    found = image_rows(spark, d).mapInArrow(run, "vec_id long, score double")
    return found.select("vec_id", rounded(F.col("score")).alias("one_minus_ssim"))


@query("q18_wiener_recovery")
def wiener_recovery(spark: SparkSession, d: str) -> DataFrame:
    """How much of a disk blur's change the Wiener filter takes back."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, *SHAPE)
            blurred = [images.defocus(im, 1, "wrap") for im in x]
            back = [images.wiener(b, 1) for b in blurred]
            far = lambda ys: [float(np.abs(y - im).mean()) for y, im in zip(ys, x, strict=True)]  # noqa: E731, B023
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "blur": far(blurred), "deblur": far(back)})

    e = image_rows(spark, d).mapInArrow(run, "vec_id long, blur double, deblur double")
    return e.agg(F.count("*").alias("n"), rounded(F.avg("blur")).alias("change_blur"), rounded(F.avg("deblur")).alias("change_deblur"), rounded(100 * (1 - F.avg("deblur") / F.avg("blur")), 4).alias("reduction_pct"))


def _maps_sql(least_area: float) -> str:
    """``label_maps.spatial_labels`` cell by cell: Lloyd's steps unrolled, box means by a table of neighbours, fills by recursion."""
    lloyd = "".join(
        f"l{k + 1} AS (SELECT vec_id, coalesce(avg(v) FILTER (v <= (a + b) / 2), any_value(a)) AS a, coalesce(avg(v) FILTER (v > (a + b) / 2 AND v <= (b + c) / 2), any_value(b)) AS b, coalesce(avg(v) FILTER (v > (b + c) / 2), any_value(c)) AS c FROM e JOIN l{k} USING (vec_id) GROUP BY vec_id),\n"
        for k in range(label_maps.ROUNDS)
    )
    three = lambda f: ", ".join(f(k) for k in range(3))
    return f"""WITH RECURSIVE e AS (SELECT vec_id, i AS pos, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) r(i)),
l0 AS (SELECT vec_id, s[11] AS a, s[33] AS b, s[54] AS c FROM (SELECT vec_id, list_sort(list(v)) AS s FROM e GROUP BY vec_id)),
{lloyd}x AS (SELECT vec_id, pos, v, exp(-abs(v - a)) AS x0, exp(-abs(v - b)) AS x1, exp(-abs(v - c)) AS x2 FROM e JOIN l{label_maps.ROUNDS} USING (vec_id)),
w AS (SELECT vec_id, pos, v, {three(lambda k: f"x{k} / (x0 + x1 + x2) AS w{k}")} FROM x),
nb AS (SELECT i AS pos, (CASE WHEN abs(i // 8 + dy) > 7 THEN 14 - abs(i // 8 + dy) ELSE abs(i // 8 + dy) END) * 8 + CASE WHEN abs(i % 8 + dx) > 7 THEN 14 - abs(i % 8 + dx) ELSE abs(i % 8 + dx) END AS other FROM range(64) r(i), range(-1, 2) y(dy), range(-1, 2) x(dx)),
m AS (SELECT w.vec_id, nb.pos, avg(v) AS mg, avg(v * v) AS mgg, {three(lambda k: f"avg(w{k}) AS m{k}, avg(v * w{k}) AS q{k}")} FROM w JOIN nb ON nb.other = w.pos GROUP BY ALL),
ab AS (SELECT *, {three(lambda k: f"m{k} - a{k} * mg AS b{k}")} FROM (SELECT vec_id, pos, mg, {three(lambda k: f"m{k}, (q{k} - mg * m{k}) / (mgg - mg * mg + {label_maps.GUIDED_EPS}) AS a{k}")} FROM m)),
mab AS (SELECT ab.vec_id, nb.pos, {three(lambda k: f"avg(a{k}) AS a{k}, avg(b{k}) AS b{k}")} FROM ab JOIN nb ON nb.other = ab.pos GROUP BY ALL),
f AS (SELECT vec_id, pos, v, {three(lambda k: f"a{k} * v + b{k} AS f{k}")} FROM mab JOIN e USING (vec_id, pos)),
pk AS (SELECT vec_id, pos, v, CASE WHEN f0 >= f1 AND f0 >= f2 THEN 0 WHEN f1 >= f2 THEN 1 ELSE 2 END AS k FROM f),
od AS (SELECT vec_id, k, row_number() OVER (PARTITION BY vec_id ORDER BY mean, k) - 1 AS raw FROM (SELECT v.vec_id, r.k, coalesce(avg(pk.v), 0.0) AS mean FROM (SELECT DISTINCT vec_id FROM e) v CROSS JOIN range(3) r(k) LEFT JOIN pk ON pk.vec_id = v.vec_id AND pk.k = r.k GROUP BY ALL)),
rw AS MATERIALIZED (SELECT vec_id, pos, raw FROM pk JOIN od USING (vec_id, k)),
dk AS MATERIALIZED (SELECT vec_id, pos FROM rw WHERE raw = 0),
rc(vec_id, pos, least) AS (SELECT vec_id, pos, pos FROM dk UNION SELECT rc.vec_id, d.pos, rc.least FROM rc JOIN dk d ON d.vec_id = rc.vec_id AND abs(d.pos // 8 - rc.pos // 8) <= 1 AND abs(d.pos % 8 - rc.pos % 8) <= 1),
rg AS MATERIALIZED (SELECT vec_id, pos, min(least) AS region FROM rc GROUP BY ALL),
fr AS MATERIALIZED (SELECT q.vec_id, q.region, i AS pos FROM (SELECT DISTINCT vec_id, region FROM rg) q CROSS JOIN range(64) r(i) ANTI JOIN rg ON rg.vec_id = q.vec_id AND rg.region = q.region AND rg.pos = i),
ot(vec_id, region, pos) AS (SELECT vec_id, region, pos FROM fr WHERE pos % 8 IN (0, 7) OR pos // 8 IN (0, 7) UNION SELECT ot.vec_id, ot.region, fr.pos FROM ot JOIN fr ON fr.vec_id = ot.vec_id AND fr.region = ot.region AND abs(fr.pos // 8 - ot.pos // 8) + abs(fr.pos % 8 - ot.pos % 8) = 1),
so AS MATERIALIZED (SELECT q.vec_id, q.region, i AS pos FROM (SELECT DISTINCT vec_id, region FROM rg) q CROSS JOIN range(64) r(i) ANTI JOIN ot ON ot.vec_id = q.vec_id AND ot.region = q.region AND ot.pos = i),
ar AS (SELECT vec_id, region, sum(CASE n WHEN 4 THEN 1.0 WHEN 3 THEN 0.5 ELSE 0 END) AS area FROM (SELECT so.vec_id, so.region, so.pos - dy * 8 - dx AS corner, count(*) AS n FROM so, range(2) y(dy), range(2) x(dx) WHERE so.pos // 8 - dy BETWEEN 0 AND 6 AND so.pos % 8 - dx BETWEEN 0 AND 6 GROUP BY ALL) GROUP BY ALL),
sl AS (SELECT DISTINCT so.vec_id, so.pos FROM so JOIN ar USING (vec_id, region) WHERE area > {least_area}),
md AS MATERIALIZED (SELECT vec_id, pos FROM rw ANTI JOIN sl USING (vec_id, pos) WHERE raw = 1),
cr AS (SELECT i AS pos, j AS other FROM range(64) r(i), range(64) s(j) WHERE abs(i // 8 - j // 8) + abs(i % 8 - j % 8) <= 1),
cn AS (SELECT pos, count(*) AS n FROM cr GROUP BY pos),
er AS (SELECT vec_id, pos FROM (SELECT vec_id, cr.pos, count(*) AS k FROM md JOIN cr ON cr.other = md.pos GROUP BY ALL) JOIN cn USING (pos) WHERE k = n),
op AS (SELECT DISTINCT er.vec_id, cr.pos FROM er JOIN cr ON cr.other = er.pos),
fi AS MATERIALIZED (SELECT rw.vec_id, rw.pos, raw, CASE WHEN sl.pos IS NOT NULL OR raw = 0 THEN 0 WHEN op.pos IS NOT NULL THEN 1 ELSE 2 END AS label FROM rw LEFT JOIN sl ON sl.vec_id = rw.vec_id AND sl.pos = rw.pos LEFT JOIN op ON op.vec_id = rw.vec_id AND op.pos = rw.pos),
rz(vec_id, k, pos, least) AS (SELECT vec_id, label, pos, pos FROM fi UNION SELECT rz.vec_id, rz.k, d.pos, rz.least FROM rz JOIN fi d ON d.vec_id = rz.vec_id AND d.label = rz.k AND abs(d.pos // 8 - rz.pos // 8) <= 1 AND abs(d.pos % 8 - rz.pos % 8) <= 1),
gi AS (SELECT vec_id, count(DISTINCT region) AS regions FROM (SELECT vec_id, pos, min(least) AS region FROM rz GROUP BY ALL) GROUP BY vec_id)
SELECT fi.vec_id, string_agg(raw::VARCHAR, '' ORDER BY fi.pos) AS labels_raw, string_agg(label::VARCHAR, '' ORDER BY fi.pos) AS labels, round(any_value(l.a), 6) AS dark, round(any_value(l.b), 6) AS middle, round(any_value(l.c), 6) AS light, round(any_value(regions) / 64, 6) AS sgi
FROM fi JOIN l{label_maps.ROUNDS} l ON l.vec_id = fi.vec_id JOIN gi ON gi.vec_id = fi.vec_id GROUP BY fi.vec_id"""


@query("p12_spatial_clusters", _maps_sql(1.0))
def spatial_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Soft assignment to three clusters, guided refinement, labels from dark to light, filled holes and opening, granularity: column expressions only."""
    made = label_maps.spatial_labels(table(spark, d, "embeddings").select("vec_id", as_double(F.col("embedding")).alias("v")), least_area=1.0)
    label = lambda name: F.array_join(F.zip_with(bitboards.cells(F.col(f"{name}0")), bitboards.cells(F.col(f"{name}1")), lambda a, b: F.when(a == 1, "0").when(b == 1, "1").otherwise("2")), "")
    centres = [rounded(F.col("centres")[k]).alias(n) for k, n in enumerate(("dark", "middle", "light"))]
    return made.select("vec_id", label("raw").alias("labels_raw"), label("set").alias("labels"), *centres, rounded(label_maps.region_count(["set0", "set1", "set2"]) / 64.0).alias("sgi"))


@query("p6_silhouette")
def silhouette(spark: SparkSession, d: str) -> DataFrame:
    """Exact mean silhouette of all unit vectors of each dataset and space by label (cosine distance).

    The mean distance of u to a class of n vectors with sum S is 1 - u.S / n, so class sums take the place of pairs. Vectors alone
    in their class, and all of a dataset with one class, count as 0.
    """
    key = ["dataset", "backbone"]
    units = clean_bank(spark, d).select(*key, "label", unit(F.col("x")).alias("u"))
    sums = units.groupBy(*key, "label").agg(F.count(F.lit(1)).alias("n"), sum_vector(F.col("u"), DIM).alias("s"))
    classes = sums.groupBy(*key).agg(F.collect_list(F.struct("label", "n", "s")).alias("classes"))
    u, mine = F.col("u"), lambda c: c["label"].eqNullSafe(F.col("label"))
    rows = units.join(F.broadcast(classes), key).select(*key, "u", F.filter("classes", mine)[0].alias("own"), F.filter("classes", lambda c: ~mine(c)).alias("rest"))  # as large as the classes
    inner = (F.col("own.n") - 1 - dot(u, F.col("own.s"), DIM) + dot(u, u, DIM)) / F.greatest(F.col("own.n") - 1, F.lit(1))
    rows = rows.select(*key, (F.col("own.n") > 1).alias("several"), inner.alias("a"), F.array_min(F.transform("rest", lambda c: 1 - dot(u, c["s"], DIM) / c["n"])).alias("b"))
    most = F.greatest("a", "b")
    value = F.when(F.col("several") & F.col("b").isNotNull() & (most > 0), (F.col("b") - F.col("a")) / most).otherwise(0.0)
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(value)).alias("silhouette"))


_ARI = with_clean("SELECT 1")[: -len("\nSELECT 1")] + """, cells AS (SELECT dataset, backbone, vec_id, i AS pos, CASE WHEN x[i + 1] < -0.05 THEN 0 WHEN x[i + 1] < 0.05 THEN 1 ELSE 2 END AS c FROM clean, range(16) r(i)),
n AS (SELECT a.dataset, a.backbone AS x, b.backbone AS y, a.c AS a, b.c AS b, count(*)::DOUBLE AS n FROM cells a JOIN cells b ON a.dataset = b.dataset AND a.vec_id = b.vec_id AND a.pos = b.pos AND a.backbone < b.backbone GROUP BY ALL),
r AS (SELECT dataset, x, y, sum(m * (m - 1) / 2) AS ra FROM (SELECT dataset, x, y, a, sum(n) AS m FROM n GROUP BY ALL) GROUP BY ALL), c AS (SELECT dataset, x, y, sum(m * (m - 1) / 2) AS rb FROM (SELECT dataset, x, y, b, sum(n) AS m FROM n GROUP BY ALL) GROUP BY ALL),
t AS (SELECT dataset, x, y, sum(n * (n - 1) / 2) AS ij, sum(n) * (sum(n) - 1) / 2 AS whole FROM n GROUP BY ALL)
SELECT t.dataset, t.x, t.y, round((ij - ra * rb / whole) / ((ra + rb) / 2 - ra * rb / whole), 6) AS ari FROM t JOIN r ON t.dataset = r.dataset AND t.x = r.x AND t.y = r.y JOIN c ON t.dataset = c.dataset AND t.x = c.x AND t.y = c.y"""


@query("p13_cross_space_ari", _ARI)
def cross_space_ari(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the label maps of two spaces: contingency counts of all vectors of a dataset in one aggregate."""
    cut = lambda v: F.when(v < -0.05, 0).when(v < 0.05, 1).otherwise(2)
    cells = clean_bank(spark, d).select("dataset", "backbone", "vec_id", F.posexplode("x").alias("pos", "v")).select("dataset", "backbone", "vec_id", "pos", cut(F.col("v")).alias("c"))
    a, b = cells.select("dataset", "vec_id", "pos", F.col("backbone").alias("x"), F.col("c").alias("a")), cells.select("dataset", "vec_id", "pos", F.col("backbone").alias("y"), F.col("c").alias("b"))
    n = a.join(b, ["dataset", "vec_id", "pos"]).filter("x < y").groupBy("dataset", "x", "y", "a", "b").agg(F.count("*").cast("double").alias("n"))
    key = ["dataset", "x", "y"]
    pairs = lambda c: c * (c - 1) / 2
    rows = n.groupBy(*key, "a").agg(F.sum("n").alias("m")).groupBy(*key).agg(F.sum(pairs(F.col("m"))).alias("ra"))
    cols = n.groupBy(*key, "b").agg(F.sum("n").alias("m")).groupBy(*key).agg(F.sum(pairs(F.col("m"))).alias("rb"))
    both = n.groupBy(*key).agg(F.sum(pairs(F.col("n"))).alias("ij"), F.sum("n").alias("all")).join(rows, key).join(cols, key)
    chance = F.col("ra") * F.col("rb") / pairs(F.col("all"))
    return both.select(*key, rounded((F.col("ij") - chance) / ((F.col("ra") + F.col("rb")) / 2 - chance)).alias("ari"))


@query("p14_kmeans_grid")
def kmeans_grid(spark: SparkSession, d: str) -> DataFrame:
    """Cost over numbers of clusters and seeds, with Spark's own k-means; spread over the seeds."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = clean_bank(spark, d).select("backbone", array_to_vector("x").alias("features")).cache()
    spaces = sorted(r["backbone"] for r in rows.select("backbone").distinct().collect())  # a few names
    out = [(b, k, s, float(KMeans(k=k, seed=s, maxIter=10).fit(rows.filter(F.col("backbone") == b)).summary.trainingCost)) for b in spaces for k in (2, 3, 4) for s in (1, 2)]
    rows.unpersist()
    costs = spark.createDataFrame(out, "backbone string, k int, seed int, cost double")
    return costs.groupBy("backbone", "k").agg(rounded(F.avg("cost"), 4).alias("mean_cost"), rounded(100 * F.stddev_pop("cost") / F.avg("cost"), 4).alias("cv_pct"))


_MAP_METRICS = ("p1_csi", "p4_sgi", "p10_entropy", "p5_adjusted_rand")


@query("p15_map_metrics", "SELECT * FROM " + " JOIN ".join(f"({oracle(n)}) USING (vec_id)" if i else f"({oracle(n)})" for i, n in enumerate(_MAP_METRICS)))
def map_metrics(spark: SparkSession, d: str) -> DataFrame:
    """All metrics of a map in one row: stability, granularity, entropy, agreement."""
    found = maps.csi(spark, d)
    for one in (maps.sgi, maps.entropy, maps.adjusted_rand):
        found = found.join(one(spark, d), "vec_id")
    return found


@query("p16_collapse", with_rec("SELECT backbone, round(100 * stddev_samp(accuracy) / avg(accuracy), 6) AS cv_pct, round(max(accuracy) - min(accuracy), 6) AS range, CASE WHEN 100 * stddev_samp(accuracy) / avg(accuracy) < 5 THEN 'collapsed' ELSE 'varied' END AS verdict FROM rec GROUP BY backbone"))
def collapse(spark: SparkSession, d: str) -> DataFrame:
    """Variation, range and verdict of a metric for each space."""
    s = F.stddev_samp("accuracy")
    r = records(spark, d).groupBy("backbone").agg((100 * s / F.avg("accuracy")).alias("cv"), (F.max("accuracy") - F.min("accuracy")).alias("range"))
    return r.select("backbone", rounded(F.col("cv")).alias("cv_pct"), rounded(F.col("range")).alias("range"), F.when(F.col("cv") < 5, "collapsed").otherwise("varied").alias("verdict"))


@query("k15_logistic_probe")
def logistic_probe(spark: SparkSession, d: str) -> DataFrame:
    """Multinomial logistic regression on a split by hash, fitted on clean rows; accuracy of the test part under every condition."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = shifted_bank(spark, d)
    test = F.conv(F.substring(F.md5(F.concat(F.lit("probe|"), F.col("vec_id").cast("string"))), 1, 4), 16, 10).cast("int") % 5 == 0
    rows = rows.select("backbone", "tag", "vec_id", F.col("label").cast("double").alias("label"), array_to_vector(unit(F.col("x"))).alias("features"), test.alias("test"))
    out = None
    for b in range(4):
        mine = rows.filter(F.col("backbone") == f"B{b}")
        model = LogisticRegression(maxIter=25, regParam=0.01, family="multinomial").fit(mine.filter("NOT test AND tag = 'clean_0'"))
        scored = model.transform(mine.filter("test")).select("backbone", "tag", (F.col("prediction") == F.col("label")).cast("double").alias("hit"))
        out = scored if out is None else out.unionByName(scored)
    return out.groupBy("backbone", "tag").agg(F.count("*").alias("n"), rounded(F.avg("hit")).alias("accuracy"))


SPLITS = 5


def _probe_rows(spark: SparkSession, d: str, share: float = 0.2) -> DataFrame:
    """Unit vectors of all conditions with held, a bit for each split: of each dataset, class and split a fifth by hash, the same in all spaces and conditions."""
    ids = clean_bank(spark, d).filter("backbone = 'B0'").select("dataset", "vec_id", "label", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))).alias("split"))
    key = ["dataset", "label", "split"]
    order = Window.partitionBy(*key).orderBy(F.md5(F.concat_ws("|", F.lit("aug"), "split", "vec_id")), "vec_id")
    sizes = ids.groupBy(*key).agg(F.count(F.lit(1)).alias("m"))
    test = F.col("r") <= F.ceil(F.col("m") * share)
    ids = ids.withColumn("r", F.row_number().over(order)).join(sizes, key).groupBy("dataset", "vec_id").agg(F.bit_or(F.when(test, F.expr("shiftleft(1, split)")).otherwise(0)).alias("held"))
    rows = paired(spark, d).select("dataset", "backbone", "tag", "vec_id", F.col("label").cast("long").alias("label"), "u", "cos")
    return rows.join(ids, ["dataset", "vec_id"])


def augmentation_records(spark: SparkSession, d: str) -> DataFrame:
    """head, training, dataset, backbone, split, tag, accuracy, drift of the test rows; made once.

    A row is held once, with the names of all the heads that it trains or tests.
    """

    def make() -> DataFrame:
        rows = written(_probe_rows(spark, d))
        held = lambda s: F.getbit("held", F.lit(s)) == 1
        name = lambda s, training, *before: F.concat_ws("/", *[F.lit(b) for b in before], "dataset", "backbone", F.lit(str(s)), F.lit(training))
        fits = [F.when(~held(s), name(s, "augmented")) for s in range(SPLITS)] + [F.when(~held(s) & (F.col("tag") == "clean_0"), name(s, "baseline")) for s in range(SPLITS)]
        trained = rows.select(F.array_compact(F.array(*fits)).alias("grp"), "label", "u")
        heads = {f"{head}/{grp}": h for head, fit in (("ridge", probes.ridge), ("logistic", probes.logistic)) for grp, h in fit(trained).items()}
        tests = [F.when(held(s), name(s, training, head)) for head in ("ridge", "logistic") for training in ("baseline", "augmented") for s in range(SPLITS)]
        tested = rows.filter("held <> 0").select("tag", "label", "cos", "u", F.array_compact(F.array(*tests)).alias("grp"))
        each = probes.predicted(tested, heads).select("tag", "label", "cos", F.explode(F.arrays_zip("grp", "predicted")).alias("z"))
        part = F.split("z.grp", "/")
        parts = [part[i].alias(c) for i, c in enumerate(("head", "dataset", "backbone", "split", "training"))]
        scored = each.select(*parts, "tag", (F.col("z.predicted") == F.col("label")).cast("double").alias("hit"), "cos")
        return scored.groupBy("training", "dataset", "backbone", "split", "tag", "head").agg(F.avg("hit").alias("accuracy"), F.avg(1 - F.col("cos")).alias("drift"))

    return once(spark, d, "augmentation", make)


@query("k16_augmentation_probe")
def augmentation_probe(spark: SparkSession, d: str) -> DataFrame:
    """Ridge and logistic heads of every dataset and space, fitted on clean rows and on clean with shifted ones, over five splits.

    Accuracy on clean and shifted test rows, the gap between them, and the correlation of a condition's drift with its drop.
    """
    r = augmentation_records(spark, d)
    key = ["head", "training", "dataset", "backbone"]
    clean = r.filter("tag = 'clean_0'").select(*key, "split", F.col("accuracy").alias("clean"))
    moved = r.filter("tag <> 'clean_0'").join(clean, [*key, "split"])
    found = moved.groupBy(*key).agg(F.countDistinct("tag").alias("conditions"), F.avg("clean").alias("c"), F.avg("accuracy").alias("p"), correlation("drift", F.col("clean") - F.col("accuracy")).alias("r"))
    return found.select(*key, "conditions", rounded(F.col("c")).alias("clean_acc"), rounded(F.col("p")).alias("pert_acc"), rounded(F.col("c") - F.col("p")).alias("gap"), rounded(F.col("r")).alias("drift_drop_r"))


@query("c11_similarity_matrix", with_units("SELECT q.dataset, q.vec_id, count(*) AS n, round(avg(list_dot_product(q.u, b.u)), 6) AS mean, round(max(list_dot_product(q.u, b.u)), 6) AS most, round(min(list_dot_product(q.u, b.u)), 6) AS least FROM cu q JOIN cu b ON q.dataset = b.dataset AND q.backbone = 'B1' AND b.backbone = 'B1' WHERE q.vec_id % 50 = 0 GROUP BY q.dataset, q.vec_id"))
def similarity_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The all-pairs similarity of a stated query set (ids divisible by 50) in blocks, as statistics of each query's row, in one space."""
    return _similarity(spark, d, "backbone = 'B1'").drop("backbone")


@query("c11_similarity_spaces", with_units("SELECT q.dataset, q.backbone, q.vec_id, count(*) AS n, round(avg(list_dot_product(q.u, b.u)), 6) AS mean, round(max(list_dot_product(q.u, b.u)), 6) AS most, round(min(list_dot_product(q.u, b.u)), 6) AS least FROM cu q JOIN cu b ON q.dataset = b.dataset AND q.backbone = b.backbone WHERE q.vec_id % 50 = 0 GROUP BY q.dataset, q.backbone, q.vec_id"))
def similarity_spaces(spark: SparkSession, d: str) -> DataFrame:
    """The same in all four spaces."""
    return _similarity(spark, d, "true")


def _similarity(spark: SparkSession, d: str, kept: str) -> DataFrame:
    from driftloom.operators.neighbours import similarities

    units = clean_bank(spark, d).filter(kept).select("dataset", "backbone", F.lit("clean").alias("tag"), "vec_id", "label", unit(F.col("x")).alias("u"))
    found = similarities(units.filter("vec_id % 50 = 0"), units, ["dataset", "backbone"])
    return found.select("dataset", "backbone", "vec_id", "n", *[rounded(F.col(c)).alias(c) for c in ("mean", "most", "least")])


@query("p_paired_change", with_units("SELECT dataset, backbone, tag, round(s, 6) AS share, round(s - avg(s) OVER (PARTITION BY dataset, backbone), 6) AS above_mean FROM (SELECT dataset, backbone, tag, avg((cos < 0.95)::DOUBLE) AS s FROM pairs GROUP BY ALL)"))
def paired_change(spark: SparkSession, d: str) -> DataFrame:
    """Share of vectors of each condition whose cosine to their clean one is below 0.95, against the mean of all conditions."""
    w = Window.partitionBy("dataset", "backbone")
    c = paired(spark, d).groupBy("dataset", "backbone", "tag").agg(F.avg((F.col("cos") < 0.95).cast("double")).alias("share"))
    return c.select("dataset", "backbone", "tag", rounded(F.col("share")).alias("share"), rounded(F.col("share") - F.avg("share").over(w)).alias("above_mean"))


@query("r4_extraction_grid", with_units("SELECT backbone, dataset, tag, count(*) AS n, round(avg(u[1]), 6) AS first, round(avg(u[16]), 6) AS last FROM su WHERE tag IN ('clean_0', 'scale_0_2') GROUP BY ALL"))
def extraction_grid(spark: SparkSession, d: str) -> DataFrame:
    """A grid of spaces, datasets and conditions through the ledger: what a space's extractor makes of every item, committed by cell.

    The extractor stands for a network: it takes a space's part of a vector to unit length.
    """
    items = shifted_bank(spark, d).filter("tag IN ('clean_0', 'scale_0_2')").select("backbone", "dataset", "tag", "vec_id", "x")
    cells = items.select("backbone", "dataset", "tag").distinct()

    def load(model: str):
        def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            u = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
            return pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "u": pa.array(u.tolist(), pa.list_(pa.float64()))})

        return extract

    ledger = Ledger(spark, fresh_folder(spark), ["backbone", "dataset", "tag"])
    ledger.run(cells, items, ["backbone", "dataset", "tag"], "backbone", load, "vec_id long, u array<double>")
    found = ledger.read("vec_id long, u array<double>").groupBy("backbone", "dataset", "tag")
    return found.agg(F.count("*").alias("n"), rounded(F.avg(F.col("u")[0])).alias("first"), rounded(F.avg(F.col("u")[15])).alias("last"))
