"""Queries of the resampling family (O)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.operators.resampling import bootstrap_rows, hash_order, without_replacement
from driftloom.plans.base import correlation, neighbour_lists, records, rounded, with_near, with_rec
from driftloom.registry import query
from driftloom.sources.store import table

#: Replicates of each bootstrap.
ACCURACY, MEAN, AUC, CORRELATION, BLOCK, CLUSTER = 1_000, 1_000, 1_000, 10_000, 5_000, 2_000
PERMUTATIONS = 10_000


def boot_sql(source: str, keys: str, order: str, seed: str, replicates: int) -> str:
    """The same draws in SQL."""
    on = " AND ".join(f"d.{k.strip()} = n.{k.strip()}" for k in keys.split(","))
    return f"""num AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS i_, count(*) OVER (PARTITION BY {keys}) AS n_ FROM {source}),
draws AS (SELECT {keys}, b AS replicate, ('0x' || substr(md5('{seed}|' || b || '|' || i_), 1, 8))::BIGINT % n_ AS i_ FROM num, range({replicates}) r(b)),
boot AS (SELECT d.replicate, n.* FROM draws d JOIN num n ON {on} AND d.i_ = n.i_)"""


@query("o1_bootstrap_accuracy", with_near("SELECT 1")[: -len("\nSELECT 1")] + ", hits AS (SELECT dataset, vec_id, (near_label = label)::DOUBLE AS hit FROM near WHERE rank = 1 AND backbone = 'B0' AND tag = 'blend_0_9'), " + boot_sql("hits", "dataset", "vec_id", "acc", ACCURACY) + " SELECT dataset, round(quantile_cont(a, 0.025), 6) AS ci_lo, round(quantile_cont(a, 0.975), 6) AS ci_hi, round(stddev_pop(a), 6) AS ci_std FROM (SELECT dataset, replicate, avg(hit) AS a FROM boot GROUP BY ALL) GROUP BY dataset")
def bootstrap_accuracy(spark: SparkSession, d: str) -> DataFrame:
    hits = neighbour_lists(spark, d).filter("rank = 1 AND backbone = 'B0' AND tag = 'blend_0_9'").select("dataset", "vec_id", (F.col("near_label") == F.col("label")).cast("double").alias("hit"))
    a = bootstrap_rows(hits, ["dataset"], ["vec_id"], ACCURACY, "acc").groupBy("dataset", "replicate").agg(F.avg("hit").alias("a"))
    return a.groupBy("dataset").agg(rounded(F.percentile("a", F.lit(0.025))).alias("ci_lo"), rounded(F.percentile("a", F.lit(0.975))).alias("ci_hi"), rounded(F.stddev_pop("a")).alias("ci_std"))


@query("o2_bootstrap_mean", with_rec("SELECT 1")[: -len("\nSELECT 1")] + ", " + boot_sql("rec", "perturbation", "dataset, backbone, tag", "mean", MEAN) + " SELECT perturbation, round(quantile_cont(a, 0.025), 6) AS lo, round(quantile_cont(a, 0.975), 6) AS hi FROM (SELECT perturbation, replicate, avg(drift) AS a FROM boot GROUP BY ALL) GROUP BY perturbation")
def bootstrap_mean(spark: SparkSession, d: str) -> DataFrame:
    a = bootstrap_rows(records(spark, d), ["perturbation"], ["dataset", "backbone", "tag"], MEAN, "mean").groupBy("perturbation", "replicate").agg(F.avg("drift").alias("a"))
    return a.groupBy("perturbation").agg(rounded(F.percentile("a", F.lit(0.025))).alias("lo"), rounded(F.percentile("a", F.lit(0.975))).alias("hi"))


@query("o3_bootstrap_auc")
def bootstrap_auc(spark: SparkSession, d: str) -> DataFrame:
    """AUC, average precision and best F1 of every replicate with both classes, from counts by score, not from pairs."""
    from driftloom.plans.metrics import curve, f1

    rows = records(spark, d).select(F.lit("all").alias("g"), "dataset", "backbone", "tag", "failure", F.col("drift").alias("score"))
    c = curve(bootstrap_rows(rows, ["g"], ["dataset", "backbone", "tag"], AUC, "auc"), ["replicate"]).filter("p > 0 AND n > 0")
    found = {
        "roc_auc": F.sum(F.col("dp") * (F.col("n") - F.col("fp") + 0.5 * F.col("dn"))) / (F.max("p") * F.max("n")),
        "avg_precision": F.sum(F.col("dp") / F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))),
        "best_f1": F.max(f1()),
    }
    each = c.groupBy("replicate").agg(*[v.alias(k) for k, v in found.items()])
    each = each.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("a")) for k in found])).alias("m")).select("m.*")
    return each.groupBy("metric").agg(rounded(F.avg("a")).alias("mean"), rounded(F.percentile("a", F.lit(0.025))).alias("lo"), rounded(F.percentile("a", F.lit(0.975))).alias("hi"))


@query("o4_bootstrap_correlation", with_rec("SELECT 1")[: -len("\nSELECT 1")] + ", " + boot_sql("rec", "backbone", "dataset, tag", "corr", CORRELATION) + " SELECT backbone, round(quantile_cont(a, 0.025), 6) AS lo, round(quantile_cont(a, 0.975), 6) AS hi FROM (SELECT backbone, replicate, corr(drift, acc_drop) AS a FROM boot GROUP BY ALL HAVING stddev_pop(drift) > 0 AND stddev_pop(acc_drop) > 0) GROUP BY backbone")
def bootstrap_correlation(spark: SparkSession, d: str) -> DataFrame:
    b = bootstrap_rows(records(spark, d), ["backbone"], ["dataset", "tag"], CORRELATION, "corr").groupBy("backbone", "replicate").agg(correlation("drift", "acc_drop").alias("a"), F.stddev_pop("drift").alias("s"), F.stddev_pop("acc_drop").alias("t"))
    b = b.filter("s > 0 AND t > 0")  # a replicate without variance has no correlation
    return b.groupBy("backbone").agg(rounded(F.percentile("a", F.lit(0.025))).alias("lo"), rounded(F.percentile("a", F.lit(0.975))).alias("hi"))


def _clusters(spark: SparkSession, d: str, keys: list[str], seed: str, column: str = "acc_drop") -> DataFrame:
    """Replicates that draw whole clusters: cluster keys are resampled, then joined to their rows."""
    r = records(spark, d)
    names = r.select(F.lit("all").alias("g"), *keys).distinct()
    drawn = bootstrap_rows(names, ["g"], keys, CLUSTER, seed)
    return r.join(drawn.drop("g"), keys).groupBy("replicate").agg(correlation("drift", column).alias("a")).agg(rounded(F.avg("a")).alias("mean"), rounded(F.percentile("a", F.lit(0.025))).alias("lo"), rounded(F.percentile("a", F.lit(0.975))).alias("hi"))


_CI = "round(avg(a), 6) AS mean, round(quantile_cont(a, 0.025), 6) AS lo, round(quantile_cont(a, 0.975), 6) AS hi"


@query("o5_block_bootstrap", with_rec("SELECT 1")[: -len("\nSELECT 1")] + ", res AS (SELECT tag, backbone, drift - avg(drift) OVER (PARTITION BY dataset) AS x, acc_drop - avg(acc_drop) OVER (PARTITION BY dataset) AS y FROM rec), names AS (SELECT DISTINCT 'all' AS g, tag FROM rec), " + boot_sql("names", "g", "tag", "block", BLOCK) + f" SELECT {_CI} FROM (SELECT replicate, corr(x, y) AS a FROM boot b JOIN res r ON b.tag = r.tag GROUP BY replicate)")
def block_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Conditions are the blocks; values are made residual once, before the draws."""
    w = Window.partitionBy("dataset")
    res = records(spark, d).select("tag", *[(F.col(c) - F.avg(c).over(w)).alias(n) for c, n in (("drift", "x"), ("acc_drop", "y"))])
    drawn = bootstrap_rows(records(spark, d).select(F.lit("all").alias("g"), "tag").distinct(), ["g"], ["tag"], BLOCK, "block")
    a = res.join(drawn, "tag").groupBy("replicate").agg(correlation("x", "y").alias("a"))
    return a.agg(rounded(F.avg("a")).alias("mean"), rounded(F.percentile("a", F.lit(0.025))).alias("lo"), rounded(F.percentile("a", F.lit(0.975))).alias("hi"))


@query("o6_cluster_bootstrap", with_rec("SELECT 1")[: -len("\nSELECT 1")] + ", names AS (SELECT DISTINCT 'all' AS g, dataset, backbone FROM rec), " + boot_sql("names", "g", "dataset, backbone", "cluster", CLUSTER) + f" SELECT {_CI} FROM (SELECT replicate, corr(r.drift, r.acc_drop) AS a FROM boot b JOIN rec r ON b.dataset = r.dataset AND b.backbone = r.backbone GROUP BY replicate)")
def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d, ["dataset", "backbone"], "cluster")


@query("o7_permutation_null_mean", with_near("SELECT n.dataset, n.backbone, round(sum(p * t)::DOUBLE / (any_value(s.n) * any_value(s.n)), 6) AS null_mean FROM (SELECT dataset, backbone, near_label AS c, count(*) AS p FROM near WHERE rank = 1 AND tag = 'blend_0_9' GROUP BY ALL) n JOIN (SELECT dataset, backbone, label AS c, count(*) AS t FROM near WHERE rank = 1 AND tag = 'blend_0_9' GROUP BY ALL) l ON n.dataset = l.dataset AND n.backbone = l.backbone AND n.c = l.c JOIN (SELECT dataset, backbone, count(*) AS n FROM near WHERE rank = 1 AND tag = 'blend_0_9' GROUP BY ALL) s ON s.dataset = n.dataset AND s.backbone = n.backbone GROUP BY n.dataset, n.backbone"))
def permutation_mean(spark: SparkSession, d: str) -> DataFrame:
    """The exact mean accuracy under permuted labels, from class counts."""
    key = ["dataset", "backbone"]
    near = neighbour_lists(spark, d).filter("rank = 1 AND tag = 'blend_0_9'")
    p = near.groupBy(*key, F.col("near_label").alias("c")).agg(F.count("*").alias("p"))
    t = near.groupBy(*key, F.col("label").alias("c")).agg(F.count("*").alias("t"))
    n = near.groupBy(*key).agg(F.count("*").cast("double").alias("n"))
    return p.join(t, [*key, "c"]).groupBy(*key).agg(F.sum(F.col("p") * F.col("t")).alias("s")).join(n, key).select(*key, rounded(F.col("s") / (F.col("n") * F.col("n"))).alias("null_mean"))


def null_accuracy(true: np.ndarray, predicted: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Hits under permuted labels, from the counts of each class among the labels and the predictions.

    Each predicted class draws its labels from those that are left, hypergeometrically, so the cost doesn't grow with the rows.
    NumPy bounds the rows of a group by 1e9.
    """
    rng = np.random.default_rng(seed)
    left, hits = np.repeat(np.asarray(true, np.int64)[None, :], replicates, axis=0), np.zeros(replicates, np.int64)
    for c, n in enumerate(predicted):
        due, rest = np.full(replicates, n, np.int64), left.sum(1)
        for t in range(len(true)):
            rest = rest - left[:, t]
            some = rng.hypergeometric(left[:, t], rest, due)
            left[:, t] -= some
            due = due - some
            if t == c:
                hits += some
    return hits


@query("o7_permutation_tail")
def permutation_tail(spark: SparkSession, d: str) -> DataFrame:
    """Share of 10,000 permutations below and above the observed accuracy, both tails, for every condition. Only class counts reach a task, so its size is bounded by classes."""
    key = ["dataset", "backbone", "tag"]
    near = neighbour_lists(spark, d).filter("rank = 1").groupBy(*key, "label", "near_label").agg(F.count("*").alias("n"))

    def tails(t: pa.Table) -> pa.Table:
        f = t.to_pandas()
        names = np.union1d(f["label"], f["near_label"])
        true, predicted = (np.bincount(np.searchsorted(names, f[c]), f["n"], len(names)).astype(np.int64) for c in ("label", "near_label"))
        seen, total = int(f["n"][f["label"] == f["near_label"]].sum()), int(f["n"].sum())
        null = null_accuracy(true, predicted, PERMUTATIONS, 10_000)
        return pa.table({**{k: [f[k].iloc[0]] for k in key}, "observed": [seen / total], "below": [float((null <= seen).mean())], "above": [float((null >= seen).mean())]})

    return near.groupBy(*key).applyInArrow(tails, "dataset string, backbone string, tag string, observed double, below double, above double")


@query("o8_stratified_split", "SELECT label, count_if(r <= floor(0.2 * n)) AS test, count_if(r > floor(0.2 * n)) AS train, sum(CASE WHEN r <= floor(0.2 * n) THEN vec_id END)::BIGINT AS test_ids FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('split|' || vec_id), vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings) GROUP BY label")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("label")
    e = table(spark, d, "embeddings").select("label", "vec_id", F.row_number().over(w.orderBy(*hash_order("split", "vec_id"))).alias("r"), F.count("*").over(w).alias("n"))
    test = F.col("r") <= F.floor(0.2 * F.col("n"))
    return e.groupBy("label").agg(F.count_if(test).alias("test"), F.count_if(~test).alias("train"), F.sum(F.when(test, F.col("vec_id"))).alias("test_ids"))


@query("o9_capped_sample", "SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('cap|' || vec_id), vec_id) AS r FROM embeddings) WHERE r <= 16")
def capped_sample(spark: SparkSession, d: str) -> DataFrame:
    return without_replacement(table(spark, d, "embeddings").select("label", "vec_id"), ["label"], 16, "cap", "vec_id")


@query("o10_balanced_sample", "SELECT dataset, label, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM (SELECT e.*, row_number() OVER (PARTITION BY e.dataset, e.label ORDER BY md5('balance|' || e.vec_id), e.vec_id) AS r, m.least FROM (SELECT vec_id, label, 'D' || (vec_id % 3) AS dataset FROM embeddings) e JOIN (SELECT label, min(n) AS least FROM (SELECT label, vec_id % 3 AS s, count(*) AS n FROM embeddings GROUP BY ALL) GROUP BY label) m ON e.label = m.label) WHERE r <= least GROUP BY dataset, label")
def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", F.concat(F.lit("D"), F.col("vec_id") % 3).alias("dataset"))
    least = e.groupBy("label", "dataset").agg(F.count("*").alias("n")).groupBy("label").agg(F.min("n").alias("least"))
    some = without_replacement(e.join(least, "label"), ["dataset", "label"], F.col("least"), "balance", "vec_id")
    return some.groupBy("dataset", "label").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


@query("o11_per_class_sample", "SELECT label, sum(vec_id)::BIGINT AS ids FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('class|' || vec_id), vec_id) AS r FROM embeddings) WHERE r <= 5 GROUP BY label")
def per_class(spark: SparkSession, d: str) -> DataFrame:
    return without_replacement(table(spark, d, "embeddings").select("label", "vec_id"), ["label"], 5, "class", "vec_id").groupBy("label").agg(F.sum("vec_id").alias("ids"))


@query("o12_matched_classes", "SELECT s AS draw, label FROM (SELECT s, label, row_number() OVER (PARTITION BY s ORDER BY md5('match|' || s || '|' || label), label) AS r FROM (SELECT DISTINCT label FROM embeddings), range(4) t(s)) WHERE r <= 4")
def matched_classes(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "embeddings").select("label").distinct().select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("draw"), "label")
    order = Window.partitionBy("draw").orderBy(F.md5(F.concat_ws("|", F.lit("match"), F.col("draw").cast("string"), F.col("label").cast("string"))), "label")
    return labels.withColumn("r", F.row_number().over(order)).filter("r <= 4").select("draw", "label")


_DRAWS = 50


@query("o12_matched_accuracy", with_near(f"""SELECT dataset, backbone, tag, count(*) AS draws, round(avg(a), 6) AS mean_accuracy, round(stddev_samp(a), 6) AS std, round(quantile_cont(a, 0.025), 6) AS ci_lo, round(quantile_cont(a, 0.975), 6) AS ci_hi
FROM (SELECT h.dataset, h.backbone, h.tag, s, sum(hits) / sum(n) AS a FROM (SELECT dataset, backbone, tag, label, count(*) AS n, sum((near_label = label)::INT) AS hits FROM near WHERE rank = 1 GROUP BY ALL) h
  JOIN (SELECT s, label, row_number() OVER (PARTITION BY s ORDER BY md5('match|' || s || '|' || label), label) AS r FROM (SELECT DISTINCT label FROM embeddings), range({_DRAWS}) t(s)) d ON d.label = h.label AND r <= 4 GROUP BY ALL) GROUP BY ALL"""))
def matched_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of every condition over draws of four classes: a draw is a bitmap of classes, held against each condition's hits and rows by class.

    Rows are read once, for the counts by class; draws meet only those.
    """
    near = neighbour_lists(spark, d).filter("rank = 1")
    counts = near.groupBy("dataset", "backbone", "tag", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("near_label") == F.col("label")).alias("hits"))
    classes = near.select("label").distinct().withColumn("bit", F.row_number().over(Window.orderBy("label")) - 1)  # a row for each class
    drawn = classes.select(F.explode(F.sequence(F.lit(0), F.lit(_DRAWS - 1))).alias("draw"), "label", "bit")
    order = Window.partitionBy("draw").orderBy(F.md5(F.concat_ws("|", F.lit("match"), F.col("draw").cast("string"), F.col("label").cast("string"))), "label")
    drawn = drawn.withColumn("r", F.row_number().over(order)).filter("r <= 4")
    maps = drawn.groupBy("draw").agg(F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("classes"))
    by = counts.join(F.broadcast(classes), "label").groupBy("dataset", "backbone", "tag").agg(F.array_agg(F.struct("bit", "hits", "n")).alias("known"))  # classes of a condition; one bit each
    held = by.crossJoin(F.broadcast(maps)).withColumn("some", F.filter("known", lambda k: F.getbit(F.col("classes"), k["bit"]) == 1))  # the draws
    total = lambda c: F.aggregate("some", F.lit(0).cast("long"), lambda t, k: t + k[c])
    a = held.filter("size(some) > 0").select("dataset", "backbone", "tag", (total("hits") / total("n")).alias("a")).groupBy("dataset", "backbone", "tag")
    return a.agg(F.count(F.lit(1)).alias("draws"), rounded(F.avg("a")).alias("mean_accuracy"), rounded(F.stddev_samp("a")).alias("std"), rounded(F.percentile("a", F.lit(0.025))).alias("ci_lo"), rounded(F.percentile("a", F.lit(0.975))).alias("ci_hi"))
