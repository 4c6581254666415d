"""Queries of the classification and retrieval family (K)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.functions.vectors import dot, mean_vector, sum_vector, unit
from driftloom.operators.neighbours import nearest_lists
from driftloom.plans.base import DIM, clean_bank, clean_neighbours, correlation, neighbour_arrays, paired, rounded, shifted_bank, sql_mean, sql_unit, with_near, with_units
from driftloom.registry import query
from driftloom.sources.store import written

KEY = ["dataset", "backbone", "tag"]


def voted(near: Column, k: int) -> Column:
    """The majority of the first k of a list of neighbours, ties to the smallest label."""
    labels = F.transform(F.slice(near, 1, k), lambda n: n["near_label"])
    votes = F.transform(F.array_distinct(labels), lambda c: F.struct(F.size(F.filter(labels, lambda x: x.eqNullSafe(c))).alias("votes"), (-c).alias("least")))
    return -F.array_max(votes)["least"]


def vote(lists: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """keys, vec_id, label, predicted: each query's vote, within its own row."""
    return lists.select(*keys, "vec_id", "label", voted(F.col("near"), k).alias("predicted"))


def sweep(lists: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """k, KEY, vec_id, label, predicted: one list serves every k."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), voted(F.col("near"), k).alias("predicted")) for k in ks])).alias("v")
    return lists.select(*KEY, "vec_id", "label", each).select(*KEY, "vec_id", "label", "v.k", "v.predicted")


def vote_sql(k: str, source: str = "near", keys: str = "dataset, backbone, tag", more: str = "") -> str:
    return f"(SELECT {keys}, vec_id, label, arg_max(near_label, votes * 1000 - near_label) AS predicted{more} FROM (SELECT {keys}, vec_id, label, near_label, count(*) AS votes{more} FROM {source} WHERE rank <= {k} GROUP BY ALL) GROUP BY ALL)"


@query("k1_knn_accuracy", with_near(f"SELECT dataset, backbone, tag, round(avg((predicted = label)::DOUBLE), 6) AS accuracy FROM {vote_sql('5')} GROUP BY ALL"))
def knn_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return neighbour_arrays(spark, d).groupBy(*KEY).agg(rounded(F.avg((F.col("vote_5") == F.col("label")).cast("double"))).alias("accuracy"))


_SPLIT = """, sp AS (SELECT vec_id, label, dataset, backbone, u, s, row_number() OVER (PARTITION BY dataset, backbone, label, s ORDER BY md5(s || '|' || vec_id), vec_id) AS r, count(*) OVER (PARTITION BY dataset, backbone, label, s) AS m FROM cu, range(5) t(s)),
cv AS (SELECT * FROM (SELECT q.dataset, q.backbone, q.s::VARCHAR AS tag, q.vec_id, q.label, b.label AS near_label, row_number() OVER (PARTITION BY q.dataset, q.backbone, q.s, q.vec_id ORDER BY list_dot_product(q.u, b.u) DESC, b.label, b.vec_id) AS rank
  FROM sp q JOIN sp b ON q.dataset = b.dataset AND q.backbone = b.backbone AND q.s = b.s AND q.r <= floor(0.2 * q.m) AND b.r > floor(0.2 * b.m)) WHERE rank <= 5)
"""


@query("k2_knn_accuracy_cv", f"{with_units('')}{_SPLIT} SELECT dataset, backbone, round(avg(a), 6) AS accuracy, round(stddev_pop(a), 6) AS accuracy_std FROM (SELECT dataset, backbone, tag, avg((predicted = label)::DOUBLE) AS a FROM {vote_sql('5', 'cv')} GROUP BY ALL) GROUP BY ALL")
def knn_accuracy_cv(spark: SparkSession, d: str) -> DataFrame:
    """Five stratified splits by hash order within a class; the first fifth of each class is the test set."""
    bank = clean_bank(spark, d).select("dataset", "backbone", "vec_id", "label", unit(F.col("x")).alias("u"), F.explode(F.array(*[F.lit(str(s)) for s in range(5)])).alias("split"))
    w = Window.partitionBy("dataset", "backbone", "label", "split")
    order = w.orderBy(F.md5(F.concat_ws("|", "split", F.col("vec_id").cast("string"))), "vec_id")
    dealt = bank.withColumn("test", F.row_number().over(order) <= F.floor(0.2 * F.count(F.lit(1)).over(w))).withColumn("tag", F.col("split"))
    near = nearest_lists(dealt.filter("test").drop("test"), dealt.filter("NOT test").drop("test"), ["dataset", "backbone", "split"], 5)
    each = vote(near, 5, KEY).groupBy(*KEY).agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("a"))
    return each.groupBy("dataset", "backbone").agg(rounded(F.avg("a")).alias("accuracy"), rounded(F.stddev_pop("a")).alias("accuracy_std"))


@query("k3_in_sample_accuracy", with_near(f"SELECT dataset, backbone, round(avg((predicted = label)::DOUBLE), 6) AS accuracy FROM {vote_sql('5')} WHERE tag = 'clean_0' GROUP BY ALL"))
def in_sample(spark: SparkSession, d: str) -> DataFrame:
    return clean_neighbours(spark, d).groupBy("dataset", "backbone").agg(rounded(F.avg((F.col("vote_5") == F.col("label")).cast("double"))).alias("accuracy"))


_OTHERS = "(SELECT *, row_number() OVER (PARTITION BY dataset, backbone, vec_id ORDER BY rank) AS other FROM near WHERE tag = 'clean_0' AND near_id <> vec_id)"


@query("k4_leave_self_out_recall", with_near(f"SELECT dataset, backbone, label, round(avg((predicted = label)::DOUBLE), 6) AS recall FROM {vote_sql('5', f'(SELECT * EXCLUDE (rank, other), other AS rank FROM {_OTHERS})')} GROUP BY dataset, backbone, label"))
def leave_self_out(spark: SparkSession, d: str) -> DataFrame:
    near = clean_neighbours(spark, d).withColumn("near", F.filter("near", lambda n: n["near_id"] != F.col("vec_id"))).filter(F.size("near") > 0)
    return vote(near, 5, KEY).groupBy("dataset", "backbone", "label").agg(rounded(F.avg((F.col("predicted") == F.col("label")).cast("double"))).alias("recall"))


_ALLK = " UNION ALL ".join(f"SELECT {k} AS k, dataset, backbone, tag, avg((predicted = label)::DOUBLE) AS a FROM {vote_sql(str(k))} GROUP BY ALL" for k in (1, 3, 5, 10))


@query("k5_k_sweep", with_near(f"SELECT k, dataset, backbone, tag, round(a, 6) AS accuracy FROM ({_ALLK})"))
def k_sweep(spark: SparkSession, d: str) -> DataFrame:
    """One list of ten neighbours serves every k."""
    return sweep(neighbour_arrays(spark, d), (1, 3, 5, 10)).groupBy("k", *KEY).agg(rounded(F.avg((F.col("predicted") == F.col("label")).cast("double"))).alias("accuracy"))


def _clean_centroids(spark: SparkSession, d: str) -> DataFrame:
    units = clean_bank(spark, d).select("dataset", "backbone", "vec_id", "label", unit(F.col("x")).alias("u"))
    return units.groupBy("dataset", "backbone", F.col("label").alias("class")).agg(unit(mean_vector(F.col("u"), DIM)).alias("c"))


def class_scores(spark: SparkSession, d: str) -> DataFrame:
    """Each sample's score for each class: its similarity to the clean centroid, under every condition."""
    units = shifted_bank(spark, d).select(*KEY, "perturbation", "vec_id", "label", unit(F.col("x")).alias("u"))
    return units.join(_clean_centroids(spark, d), ["dataset", "backbone"]).select(*KEY, "perturbation", "vec_id", "label", "class", dot(F.col("u"), F.col("c"), DIM).alias("score"))


SCORES = (
    f", cc AS (SELECT dataset, backbone, class, {sql_unit('m')} AS c FROM (SELECT dataset, backbone, label AS class, {sql_mean('u')} AS m FROM cu GROUP BY ALL)),\n"
    "sc AS (SELECT s.dataset, s.backbone, s.tag, s.perturbation, s.vec_id, s.label, k.class, list_dot_product(s.u, k.c) AS score FROM su s JOIN cc k ON s.dataset = k.dataset AND s.backbone = k.backbone),\n"
    "mg AS (SELECT dataset, backbone, tag, perturbation, vec_id, label, max(CASE WHEN class = label THEN score END) - max(CASE WHEN class <> label THEN score END) AS margin, arg_max(class, score) AS predicted, arg_max(CASE WHEN class <> label THEN class END, CASE WHEN class <> label THEN score END) AS rival FROM sc GROUP BY ALL)\n"
)


def margins(spark: SparkSession, d: str) -> DataFrame:
    own, other = F.col("class") == F.col("label"), F.col("class") != F.col("label")
    return class_scores(spark, d).groupBy(*KEY, "perturbation", "vec_id", "label").agg(
        (F.max(F.when(own, F.col("score"))) - F.max(F.when(other, F.col("score")))).alias("margin"),
        F.max_by("class", "score").alias("predicted"),
        F.max_by(F.when(other, F.col("class")), F.when(other, F.col("score"))).alias("rival"),
    )


@query("k6_nearest_centroid", with_units("") + SCORES + "SELECT dataset, backbone, tag, round(avg((predicted = label)::DOUBLE), 6) AS accuracy FROM mg GROUP BY ALL")
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    return margins(spark, d).groupBy(*KEY).agg(rounded(F.avg((F.col("predicted") == F.col("label")).cast("double"))).alias("accuracy"))


@query("k7_cross_source_accuracy", with_units("") + SCORES + """, x AS (SELECT k.dataset AS source, s.dataset AS target, s.backbone, s.vec_id, s.label, arg_max(k.class, list_dot_product(s.u, k.c)) AS predicted FROM cu s JOIN cc k ON s.backbone = k.backbone AND s.dataset <> k.dataset GROUP BY ALL)
SELECT source, target, backbone, round(avg(r), 6) AS macro_recall FROM (SELECT source, target, backbone, label, avg((predicted = label)::DOUBLE) AS r FROM x GROUP BY ALL) GROUP BY ALL""")
def cross_source(spark: SparkSession, d: str) -> DataFrame:
    cent = _clean_centroids(spark, d).withColumnRenamed("dataset", "source")
    units = clean_bank(spark, d).select(F.col("dataset").alias("target"), "backbone", "vec_id", "label", unit(F.col("x")).alias("u"))
    best = units.join(cent, "backbone").filter("source <> target").groupBy("source", "target", "backbone", "vec_id", "label").agg(F.max_by("class", dot(F.col("u"), F.col("c"), DIM)).alias("predicted"))
    each = best.groupBy("source", "target", "backbone", "label").agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("r"))
    return each.groupBy("source", "target", "backbone").agg(rounded(F.avg("r")).alias("macro_recall"))


TRANSFER = """, tr AS (SELECT * FROM (SELECT b.dataset AS source, q.dataset AS target, q.backbone, q.vec_id, q.label, b.label AS near_label,
  row_number() OVER (PARTITION BY b.dataset, q.dataset, q.backbone, q.vec_id ORDER BY list_dot_product(q.u, b.u) DESC, b.label, b.vec_id) AS rank
  FROM cu q JOIN cu b ON q.backbone = b.backbone AND (q.dataset <> b.dataset OR q.vec_id <> b.vec_id)) WHERE rank <= 5)
"""


def transfer_votes(spark: SparkSession, d: str) -> DataFrame:
    """source, target, backbone, vec_id, label, predicted: every bank against every query set, a vector never against itself."""
    units = clean_bank(spark, d).select("dataset", "backbone", "vec_id", "label", unit(F.col("x")).alias("u"))
    names = [f"D{i}" for i in range(3)]
    q = units.select(F.explode(F.array(*[F.lit(x) for x in names])).alias("source"), "backbone", F.col("dataset").alias("tag"), "vec_id", "label", "u")
    b = units.select(F.col("dataset").alias("source"), "backbone", F.col("dataset").alias("tag"), "vec_id", "label", "u")
    near = nearest_lists(q, b, ["source", "backbone"], 5, other_than_self=True)
    return vote(near, 5, ["source", "tag", "backbone"]).withColumnRenamed("tag", "target")


TV = vote_sql("5", "tr", "source, target, backbone")


@query("k8_transfer_matrix", with_units("") + TRANSFER + f"SELECT source, target, backbone, count(*) AS n_test, round(avg((predicted = label)::DOUBLE), 6) AS accuracy FROM {TV} GROUP BY ALL")
def transfer_matrix(spark: SparkSession, d: str) -> DataFrame:
    return transfer_votes(spark, d).groupBy("source", "target", "backbone").agg(F.count(F.lit(1)).alias("n_test"), rounded(F.avg((F.col("predicted") == F.col("label")).cast("double"))).alias("accuracy"))


@query("k9_direction_records", with_units("") + TRANSFER + SCORES.replace(", cc AS", ", cc AS", 1).split(",\nsc AS")[0] + f""", v AS (SELECT source, target, backbone, label, count(*) AS n, avg((predicted = label)::DOUBLE) AS recall FROM {TV} GROUP BY ALL)
SELECT c.source || '->' || c.target AS direction, c.backbone, c.label, round(w.recall, 6) AS within_source_recall, round(c.recall, 6) AS cross_source_recall, round(w.recall - c.recall, 6) AS accuracy_drop, round(1 - list_dot_product(a.c, b.c), 6) AS centroid_drift, w.n AS n_source, c.n AS n_target
FROM v c JOIN v w ON w.source = c.source AND w.target = c.source AND w.backbone = c.backbone AND w.label = c.label
JOIN cc a ON a.dataset = c.source AND a.backbone = c.backbone AND a.class = c.label JOIN cc b ON b.dataset = c.target AND b.backbone = c.backbone AND b.class = c.label WHERE c.source <> c.target""")
def direction_records(spark: SparkSession, d: str) -> DataFrame:
    v = transfer_votes(spark, d).groupBy("source", "target", "backbone", "label").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("recall"))
    cross = v.filter("source <> target").withColumnRenamed("n", "n_target").withColumnRenamed("recall", "cross")
    within = v.filter("source = target").select("source", "backbone", "label", F.col("n").alias("n_source"), F.col("recall").alias("within"))
    cent = _clean_centroids(spark, d)
    a = cent.select(F.col("dataset").alias("source"), "backbone", F.col("class").alias("label"), F.col("c").alias("ca"))
    b = cent.select(F.col("dataset").alias("target"), "backbone", F.col("class").alias("label"), F.col("c").alias("cb"))
    all_ = cross.join(within, ["source", "backbone", "label"]).join(a, ["source", "backbone", "label"]).join(b, ["target", "backbone", "label"])
    return all_.select(F.concat_ws("->", "source", "target").alias("direction"), "backbone", "label", rounded(F.col("within")).alias("within_source_recall"), rounded(F.col("cross")).alias("cross_source_recall"), rounded(F.col("within") - F.col("cross")).alias("accuracy_drop"), rounded(1 - dot(F.col("ca"), F.col("cb"), DIM)).alias("centroid_drift"), "n_source", "n_target")


def _sum_sql(alias: str) -> str:
    return "[" + ", ".join(f"sum({alias}[{i}])" for i in range(1, 17)) + "]"


@query("k10_source_probe", with_units("") + f""", bal AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY backbone, label, dataset ORDER BY md5('probe|' || vec_id), vec_id) AS r FROM cu) JOIN (SELECT backbone, label, min(n) AS least FROM (SELECT backbone, label, dataset, count(*) AS n FROM cu GROUP BY ALL) GROUP BY ALL) USING (backbone, label) WHERE r <= least),
part AS (SELECT backbone, dataset, label, {_sum_sql('u')} AS s FROM bal GROUP BY ALL), tot AS (SELECT backbone, dataset, {_sum_sql('u')} AS t FROM bal GROUP BY ALL),
held AS (SELECT p.backbone, p.dataset, p.label, list_transform(range(1, 17), lambda i: t.t[i] - p.s[i]) AS c FROM part p JOIN tot t ON p.backbone = t.backbone AND p.dataset = t.dataset),
pr AS (SELECT b.backbone, b.label, b.dataset, b.vec_id, arg_max(h.dataset, list_cosine_similarity(b.u, h.c)) AS predicted FROM bal b JOIN held h ON b.backbone = h.backbone AND b.label = h.label GROUP BY ALL)
SELECT backbone, count(*) AS n, round(avg((predicted = dataset)::DOUBLE), 6) AS source_accuracy FROM pr GROUP BY ALL""")
def source_probe(spark: SparkSession, d: str) -> DataFrame:
    """Leave one class out: a source's centroid without a class is its total minus the class's sum; one aggregation."""
    units = clean_bank(spark, d).select("dataset", "backbone", "vec_id", "label", unit(F.col("x")).alias("u"))
    least = units.groupBy("backbone", "label", "dataset").agg(F.count(F.lit(1)).alias("n")).groupBy("backbone", "label").agg(F.min("n").alias("least"))
    order = Window.partitionBy("backbone", "label", "dataset").orderBy(F.md5(F.concat(F.lit("probe|"), F.col("vec_id").cast("string"))), "vec_id")
    balanced = units.withColumn("r", F.row_number().over(order)).join(least, ["backbone", "label"]).filter("r <= least")
    part = balanced.groupBy("backbone", "dataset", "label").agg(sum_vector(F.col("u"), DIM).alias("s"))
    total = part.groupBy("backbone", "dataset").agg(sum_vector(F.col("s"), DIM).alias("t"))
    held = part.join(total, ["backbone", "dataset"]).select("backbone", "label", F.col("dataset").alias("source"), unit(F.zip_with("t", "s", lambda a, b: a - b)).alias("c"))
    best = balanced.join(held, ["backbone", "label"]).groupBy("backbone", "label", "dataset", "vec_id").agg(F.max_by("source", dot(F.col("u"), F.col("c"), DIM)).alias("predicted"))
    return best.groupBy("backbone").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg((F.col("predicted") == F.col("dataset")).cast("double"))).alias("source_accuracy"))


_BY_SEED = """, sized AS (SELECT backbone, label, min(n) AS least, count(*) AS sources FROM (SELECT backbone, label, dataset, count(*) AS n FROM cu GROUP BY ALL) GROUP BY ALL), shared AS (SELECT * FROM sized WHERE sources = (SELECT count(DISTINCT dataset) FROM cu)),
al AS (SELECT cu.* FROM cu JOIN shared USING (backbone, label)),
ra AS (SELECT backbone, dataset, """ + _sum_sql("u") + """ AS c FROM al GROUP BY ALL),
rs AS (SELECT al.backbone, al.dataset, al.vec_id, arg_max(ra.dataset, list_cosine_similarity(al.u, ra.c)) AS predicted FROM al JOIN ra ON ra.backbone = al.backbone GROUP BY ALL),
sd AS (SELECT * FROM (SELECT al.*, seed, least, row_number() OVER (PARTITION BY al.backbone, label, dataset, seed ORDER BY md5('held|' || seed || '|' || vec_id), vec_id) AS r FROM al JOIN shared USING (backbone, label), (VALUES (11), (23), (37), (53), (71)) v(seed)) WHERE r <= least),
sp AS (SELECT *, r <= least(greatest(1, CAST(round(0.2::DOUBLE * least) AS BIGINT)), least - 1) AS test FROM sd),
sc AS (SELECT backbone, seed, dataset, """ + _sum_sql("u") + """ AS c FROM sp WHERE NOT test GROUP BY ALL),
sq AS (SELECT t.backbone, t.seed, t.dataset, t.vec_id, arg_max(sc.dataset, list_cosine_similarity(t.u, sc.c)) AS predicted FROM sp t JOIN sc ON sc.backbone = t.backbone AND sc.seed = t.seed WHERE t.test GROUP BY ALL),
se AS (SELECT backbone, seed, count(*) AS n, avg((predicted = dataset)::DOUBLE) AS a FROM sq GROUP BY ALL)
"""


@query("k10_source_protocols", with_units("") + _BY_SEED + "SELECT backbone, 'resubstitution' AS protocol, count(*) AS n, round(avg((predicted = dataset)::DOUBLE), 6) AS accuracy, NULL::DOUBLE AS std FROM rs GROUP BY ALL UNION ALL SELECT backbone, 'heldout_images', sum(n)::BIGINT, round(avg(a), 6), round(stddev_samp(a), 6) FROM se GROUP BY backbone")
def source_protocols(spark: SparkSession, d: str) -> DataFrame:
    """Is a vector's source its nearest source centroid? On the rows that made the centroids, and on held-out rows of balanced classes.

    Only classes that all sources have take part. For five seeds a fifth of each balanced class and source is held out; its sums are taken
    from the source's totals, so rows are aggregated once for all seeds.
    """
    key = ["backbone", "label"]
    units = clean_bank(spark, d).select("dataset", "backbone", "vec_id", "label", unit(F.col("x")).alias("u"))
    sizes = units.groupBy(*key, "dataset").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("sources"))
    every = units.select("dataset").distinct().agg(F.count(F.lit(1)).alias("every"))
    shared = sizes.crossJoin(F.broadcast(every)).filter("sources = every").select(*key, "least")  # one number
    rows = written(units.join(shared, key))
    centres = rows.groupBy("backbone", "dataset").agg(unit(sum_vector(F.col("u"), DIM)).alias("c"))
    hit = lambda some, by: some.groupBy(*by, "dataset", "vec_id").agg(F.max_by("source", dot(F.col("u"), F.col("c"), DIM)).alias("predicted")).withColumn("hit", (F.col("predicted") == F.col("dataset")).cast("double"))
    same = hit(rows.join(centres.withColumnRenamed("dataset", "source"), "backbone"), ["backbone"])
    first = same.groupBy("backbone").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("hit")).alias("accuracy")).withColumn("std", F.lit(None).cast("double")).withColumn("protocol", F.lit("resubstitution"))
    seeded = rows.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in (11, 23, 37, 53, 71)])))
    order = Window.partitionBy(*key, "dataset", "seed").orderBy(F.md5(F.concat_ws("|", F.lit("held"), "seed", "vec_id")), "vec_id")
    seeded = seeded.withColumn("r", F.row_number().over(order)).filter("r <= least")
    seeded = written(seeded.withColumn("test", F.col("r") <= F.least(F.greatest(F.lit(1), F.round(F.col("least") * 0.2).cast("long")), F.col("least") - 1)))
    total = seeded.groupBy("backbone", "seed", "dataset").agg(sum_vector(F.col("u"), DIM).alias("t"), F.array(*[F.sum(F.when(F.col("test"), F.col("u")[i]).otherwise(0.0)) for i in range(DIM)]).alias("h"))
    centres = total.select("backbone", "seed", F.col("dataset").alias("source"), unit(F.zip_with("t", "h", lambda a, b: a - b)).alias("c"))
    held = hit(seeded.filter("test").join(centres, ["backbone", "seed"]), ["backbone", "seed"]).groupBy("backbone", "seed").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("a"))
    second = held.groupBy("backbone").agg(F.sum("n").alias("n"), rounded(F.avg("a")).alias("accuracy"), rounded(F.stddev_samp("a")).alias("std")).withColumn("protocol", F.lit("heldout_images"))
    return first.unionByName(second).select("backbone", "protocol", "n", "accuracy", "std")


@query("k11_margin", with_units("") + SCORES + "SELECT dataset, backbone, tag, vec_id, round(margin, 6) AS margin, predicted, rival FROM mg")
def margin(spark: SparkSession, d: str) -> DataFrame:
    return margins(spark, d).select(*KEY, "vec_id", rounded(F.col("margin")).alias("margin"), "predicted", "rival")


@query("k12_margin_gate", with_units("") + SCORES + """, j AS (SELECT s.dataset, s.backbone, s.tag, k.margin, (k.margin > 0 AND s.margin <= 0) AS flip, 1 - p.cos AS drift FROM mg s JOIN mg k ON k.dataset = s.dataset AND k.backbone = s.backbone AND k.vec_id = s.vec_id AND k.tag = 'clean_0' JOIN pairs p ON p.dataset = s.dataset AND p.backbone = s.backbone AND p.tag = s.tag AND p.vec_id = s.vec_id WHERE s.tag <> 'clean_0' AND k.margin > 0)
SELECT dataset, backbone, tag, count(*) AS n, sum(flip::INT) AS flips, round(avg((drift < margin * margin / 8)::DOUBLE), 6) AS certified_share, sum((flip AND drift < margin * margin / 8)::INT) AS certified_flips, round(avg(CASE WHEN flip THEN (drift >= margin * margin / 8)::DOUBLE END), 6) AS necessary_fraction FROM j GROUP BY ALL""")
def margin_gate(spark: SparkSession, d: str) -> DataFrame:
    """A sample that moved by less than margin^2 / 8 can't change its nearest centroid; certified flips are 0."""
    m = margins(spark, d)
    clean = m.filter("perturbation = 'clean'").select("dataset", "backbone", "vec_id", F.col("margin").alias("gamma")).filter("gamma > 0")
    moved = paired(spark, d).filter("perturbation <> 'clean'").select(*KEY, "vec_id", (1 - F.col("cos")).alias("drift"))
    j = m.filter("perturbation <> 'clean'").join(clean, ["dataset", "backbone", "vec_id"]).join(moved, [*KEY, "vec_id"])
    flip, safe = F.col("margin") <= 0, F.col("drift") < F.col("gamma") * F.col("gamma") / 8
    return j.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(flip).alias("flips"), rounded(F.avg(safe.cast("double"))).alias("certified_share"),
        F.count_if(flip & safe).alias("certified_flips"), rounded(F.avg(F.when(flip, (~safe).cast("double")))).alias("necessary_fraction"),
    )


def first_order(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are right when clean, under every shift: margin, p (the margin against the clean rival alone, after the move) and drift."""
    m = margins(spark, d)
    clean = m.filter("perturbation = 'clean' AND margin > 0").select("dataset", "backbone", "vec_id", F.col("margin").alias("gamma"), F.col("rival").alias("first_rival"))
    cent = _clean_centroids(spark, d)
    a = cent.select("dataset", "backbone", F.col("class").alias("label"), F.col("c").alias("ca"))
    b = cent.select("dataset", "backbone", F.col("class").alias("first_rival"), F.col("c").alias("cb"))
    moved = paired(spark, d).filter("perturbation <> 'clean'").select(*KEY, "vec_id", "u", "c", (1 - F.col("cos")).alias("drift"))
    j = m.filter("perturbation <> 'clean'").join(clean, ["dataset", "backbone", "vec_id"]).join(moved, [*KEY, "vec_id"]).join(a, ["dataset", "backbone", "label"]).join(b, ["dataset", "backbone", "first_rival"])
    step = lambda c: dot(F.col("u"), F.col(c), DIM) - dot(F.col("c"), F.col(c), DIM)
    return j.withColumn("p", F.col("gamma") + step("ca") - step("cb"))


@query("k13_first_order_margin", with_units("") + SCORES + """, j AS (SELECT s.dataset, s.backbone, s.tag, s.margin, k.margin + (list_dot_product(p.u, a.c) - list_dot_product(p.c, a.c)) - (list_dot_product(p.u, b.c) - list_dot_product(p.c, b.c)) AS predicted_margin
 FROM mg s JOIN mg k ON k.dataset = s.dataset AND k.backbone = s.backbone AND k.vec_id = s.vec_id AND k.tag = 'clean_0' JOIN pairs p ON p.dataset = s.dataset AND p.backbone = s.backbone AND p.tag = s.tag AND p.vec_id = s.vec_id
 JOIN cc a ON a.dataset = s.dataset AND a.backbone = s.backbone AND a.class = s.label JOIN cc b ON b.dataset = s.dataset AND b.backbone = s.backbone AND b.class = k.rival WHERE s.tag <> 'clean_0' AND k.margin > 0)
SELECT dataset, backbone, tag, count(*) AS n, sum((margin <= 0)::INT) AS flips, sum((margin <= 0 AND predicted_margin <= 0)::INT) AS first_order_flips, round(avg(predicted_margin), 6) AS mean_predicted FROM j GROUP BY ALL""")
def first_order_margin(spark: SparkSession, d: str) -> DataFrame:
    """The margin against the clean rival alone, after the move."""
    j = first_order(spark, d)
    return j.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("margin") <= 0).alias("flips"), F.count_if((F.col("margin") <= 0) & (F.col("p") <= 0)).alias("first_order_flips"), rounded(F.avg("p")).alias("mean_predicted"))


@query("k14_competitor_switching", with_units("") + SCORES + """, rk AS (SELECT dataset, backbone, vec_id, class, row_number() OVER (PARTITION BY dataset, backbone, vec_id ORDER BY score DESC, class) AS r FROM sc WHERE tag = 'clean_0'),
f AS (SELECT s.perturbation, r.r FROM mg s JOIN mg k ON k.dataset = s.dataset AND k.backbone = s.backbone AND k.vec_id = s.vec_id AND k.tag = 'clean_0' AND k.margin > 0 JOIN rk r ON r.dataset = s.dataset AND r.backbone = s.backbone AND r.vec_id = s.vec_id AND r.class = s.predicted WHERE s.tag <> 'clean_0' AND s.margin < 0)
SELECT perturbation, count(*) AS flips, round(avg((r = 2)::DOUBLE), 6) AS rank2, round(avg((r >= 3)::DOUBLE), 6) AS rank3_up, round(avg((r <= 5)::DOUBLE), 6) AS within5, median(r)::DOUBLE AS median_rank FROM f GROUP BY ALL""")
def competitor_switching(spark: SparkSession, d: str) -> DataFrame:
    """The clean rank of the class that wins after the shift."""
    scores = class_scores(spark, d).filter("perturbation = 'clean'")
    order = Window.partitionBy("dataset", "backbone", "vec_id").orderBy(F.col("score").desc(), "class")
    ranks = scores.select("dataset", "backbone", "vec_id", F.col("class").alias("predicted"), F.row_number().over(order).alias("r"))
    m = margins(spark, d)
    right = m.filter("perturbation = 'clean' AND margin > 0").select("dataset", "backbone", "vec_id")
    f = m.filter("perturbation <> 'clean' AND margin < 0").join(right, ["dataset", "backbone", "vec_id"], "left_semi").join(ranks, ["dataset", "backbone", "vec_id", "predicted"])
    share = lambda c: rounded(F.avg(c.cast("double")))
    r = F.col("r")
    return f.groupBy("perturbation").agg(F.count(F.lit(1)).alias("flips"), share(r == 2).alias("rank2"), share(r >= 3).alias("rank3_up"), share(r <= 5).alias("within5"), F.median("r").alias("median_rank"))


_K17 = f"SELECT r.k, round(avg(r.a), 6) AS mean_accuracy, round(corr(r.a, p.drift), 6) AS r_drift FROM ({_ALLK}) r JOIN (SELECT dataset, backbone, tag, avg(1 - cos) AS drift FROM pairs GROUP BY ALL) p ON r.dataset = p.dataset AND r.backbone = p.backbone AND r.tag = p.tag WHERE r.tag <> 'clean_0' GROUP BY r.k"


@query("k17_rule_summary", with_near(f"SELECT *, (SELECT string_agg(k::VARCHAR, ' > ' ORDER BY mean_accuracy DESC, k) FROM ({_K17})) AS ranking FROM ({_K17})"))
def rule_summary(spark: SparkSession, d: str) -> DataFrame:
    drift = paired(spark, d).groupBy(*KEY).agg(F.avg(1 - F.col("cos")).alias("drift"))
    each = sweep(neighbour_arrays(spark, d).filter("tag <> 'clean_0'"), (1, 3, 5, 10)).groupBy("k", *KEY).agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("a")).join(drift, KEY)
    rules = each.groupBy("k").agg(rounded(F.avg("a")).alias("mean_accuracy"), rounded(correlation("a", "drift")).alias("r_drift"))
    order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("mean_accuracy")).alias("m"), F.col("k")))), lambda s: s["k"].cast("string")), " > ")
    return rules.crossJoin(F.broadcast(rules.agg(order.alias("ranking"))))  # four rows and one
