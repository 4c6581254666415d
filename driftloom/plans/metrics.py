"""Queries of the detection-metric family (M): scores against the failure label of the condition records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.plans.base import correlation, records, rounded, with_rec
from driftloom.registry import query

SCORES = ("drift", "knn1", "knn5", "centroid")


def scored(spark: SparkSession, d: str) -> DataFrame:
    """One row for each record and detector: detector, score, failure, acc_drop and the keys."""
    stack = F.explode(F.array(*[F.struct(F.lit(s).alias("detector"), F.col(s).alias("score")) for s in SCORES])).alias("x")
    r = records(spark, d)
    return r.select("dataset", "backbone", "perturbation", "severity", "failure", "acc_drop", stack).select("*", "x.detector", "x.score").drop("x")


LONG = ", lg AS (SELECT dataset, backbone, perturbation, severity, failure, acc_drop, detector, score FROM rec UNPIVOT (score FOR detector IN (drift, knn1, knn5, centroid)))"
#: Cumulative counts at each distinct score, highest first.
CURVE = LONG + """, cv AS (SELECT detector, score, sum(sum(failure)) OVER w AS tp, sum(sum(1 - failure)) OVER w AS fp, sum(sum(failure)) OVER (PARTITION BY detector) AS p, sum(sum(1 - failure)) OVER (PARTITION BY detector) AS n, sum(failure) AS dp
  FROM lg GROUP BY detector, score WINDOW w AS (PARTITION BY detector ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""


def curve(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, score, tp, fp (alarms at or above the score), p, n, dp: rows are first counted by score, so ties cost one row."""
    by = rows.groupBy(*keys, "score").agg(F.sum("failure").alias("dp"), F.sum(1 - F.col("failure")).alias("dn"))
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    return by.withColumns({"tp": F.sum("dp").over(w), "fp": F.sum("dn").over(w), "p": F.sum("dp").over(whole), "n": F.sum("dn").over(whole)})


def auc(rows: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """keys, auc, n: the average-rank form, from counts by score; keys with fewer than ``least`` of a class are left out."""
    c = curve(rows, keys).filter((F.col("p") >= least) & (F.col("n") >= least))
    # negatives strictly below a score, and half of those at it
    below = F.col("n") - F.col("fp") + 0.5 * F.col("dn")
    return c.groupBy(*keys).agg((F.sum(F.col("dp") * below) / (F.max("p") * F.max("n"))).alias("auc"), (F.max("p") + F.max("n")).alias("count"))


def _auc_sql(keys: str, least: int, where: str = "true") -> str:
    return f"SELECT {keys}, round((sum(CASE WHEN failure = 1 THEN rk END) - p * (p + 1) / 2.0) / (p * n), 6) AS auc, p + n AS count FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0 AS rk, sum(failure) OVER (PARTITION BY {keys}) AS p, sum(1 - failure) OVER (PARTITION BY {keys}) AS n FROM lg WHERE {where}) WHERE p >= {least} AND n >= {least} GROUP BY {keys}, p, n"


@query("m1_roc_auc", with_rec("") + LONG + _auc_sql("detector", 1))
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return auc(scored(spark, d), ["detector"]).select("detector", rounded(F.col("auc")).alias("auc"), "count")


@query("m2_average_precision", with_rec("") + CURVE + "SELECT detector, round(sum(dp / p * tp / (tp + fp)), 6) AS avg_precision FROM cv GROUP BY detector")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    c = curve(scored(spark, d), ["detector"])
    return c.groupBy("detector").agg(rounded(F.sum(F.col("dp") / F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))).alias("avg_precision"))


def f1(tp: str = "tp", fp: str = "fp", p: str = "p") -> Column:
    prec, rec = F.col(tp) / (F.col(tp) + F.col(fp)), F.col(tp) / F.col(p)
    return 2 * prec * rec / (prec + rec + 1e-9)


_F1 = "2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p + 1e-9)"


def best_f1(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, best_f1, best_threshold: of equal F1 the lowest threshold."""
    c = curve(rows, keys).filter("p > 0").withColumn("f1", F.round(f1(), 12))
    return c.groupBy(*keys).agg(F.max("f1").alias("best_f1"), F.max_by("score", F.struct(F.col("f1"), -F.col("score"))).alias("best_threshold"))


@query("m3_best_f1", with_rec("") + CURVE + f"SELECT detector, round(f1, 6) AS best_f1, score AS best_threshold FROM (SELECT *, round({_F1}, 12) AS f1, row_number() OVER (PARTITION BY detector ORDER BY round({_F1}, 12) DESC, score) AS k FROM cv) WHERE k = 1")
def best_f1_threshold(spark: SparkSession, d: str) -> DataFrame:
    return best_f1(scored(spark, d), ["detector"]).select("detector", rounded(F.col("best_f1")).alias("best_f1"), "best_threshold")


@query("m4_failure_label", with_rec("SELECT dataset, backbone, tag, (acc_drop > 0.20)::INT AS failure FROM rec"))
def failure_label(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("dataset", "backbone", "tag", (F.col("acc_drop") > 0.20).cast("int").alias("failure"))


_LIMITS = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30)


@query("m5_threshold_sweep", with_rec("") + ", lg AS (SELECT t AS cut, drift AS score, (acc_drop > t)::INT AS failure FROM rec, (VALUES " + ", ".join(f"({t}::DOUBLE)" for t in _LIMITS) + ") v(t))" + _auc_sql("cut", 5))
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).select(F.col("drift").alias("score"), "acc_drop", F.explode(F.array(*[F.lit(t) for t in _LIMITS])).alias("cut")).withColumn("failure", (F.col("acc_drop") > F.col("cut")).cast("int"))
    return auc(r, ["cut"], 5).select("cut", rounded(F.col("auc")).alias("auc"), "count")


@query("m6_auc_by_group", with_rec("") + LONG + " SELECT 'backbone' AS level, backbone AS name, detector, auc, count FROM (" + _auc_sql("backbone, detector", 3) + ") UNION ALL SELECT 'dataset', dataset, detector, auc, count FROM (" + _auc_sql("dataset, detector", 3) + ")")
def auc_by_group(spark: SparkSession, d: str) -> DataFrame:
    levels = F.explode(F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).alias("name")) for c in ("backbone", "dataset")])).alias("l")
    rows = scored(spark, d).select("failure", "detector", "score", levels).select("failure", "detector", "score", "l.level", "l.name")
    return auc(rows, ["level", "name", "detector"], 3).select("level", "name", "detector", rounded(F.col("auc")).alias("auc"), "count")


_GRID = tuple(round(0.05 * i, 2) for i in range(1, 15))


@query("m7_operating_points", with_rec("") + "SELECT t AS threshold, count_if(drift > t AND failure = 1) AS tp, count_if(drift > t AND failure = 0) AS fp, count_if(NOT drift > t AND failure = 0) AS tn, count_if(NOT drift > t AND failure = 1) AS fn FROM rec, (VALUES " + ", ".join(f"({t}::DOUBLE)" for t in _GRID) + ") v(t) GROUP BY t")
def operating_points(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).select("drift", "failure", F.explode(F.array(*[F.lit(t) for t in _GRID])).alias("threshold"))
    alarm, bad = F.col("drift") > F.col("threshold"), F.col("failure") == 1
    return r.groupBy("threshold").agg(F.count_if(alarm & bad).alias("tp"), F.count_if(alarm & ~bad).alias("fp"), F.count_if(~alarm & ~bad).alias("tn"), F.count_if(~alarm & bad).alias("fn"))


@query("m8_fixed_rates", with_rec("") + CURVE + "SELECT detector, round(coalesce(max(CASE WHEN fp / n <= 0.05 THEN tp / p END), 0), 6) AS tpr_at_fpr_05, round(coalesce(max(CASE WHEN fp / n <= 0.10 THEN tp / p END), 0), 6) AS tpr_at_fpr_10, round(min(CASE WHEN tp / p >= 0.90 THEN fp / n END), 6) AS fpr_at_tpr_90, round(min(CASE WHEN tp / p >= 0.95 THEN fp / n END), 6) AS fpr_at_tpr_95 FROM cv GROUP BY detector")
def fixed_rates(spark: SparkSession, d: str) -> DataFrame:
    """On the full curve; a curve thinned to its corners can differ on tied diagonals."""
    c = curve(scored(spark, d), ["detector"])
    tpr, fpr = F.col("tp") / F.col("p"), F.col("fp") / F.col("n")
    high = lambda t: rounded(F.coalesce(F.max(F.when(fpr <= t, tpr)), F.lit(0.0)))
    low = lambda t: rounded(F.min(F.when(tpr >= t, fpr)))
    return c.groupBy("detector").agg(high(0.05).alias("tpr_at_fpr_05"), high(0.10).alias("tpr_at_fpr_10"), low(0.90).alias("fpr_at_tpr_90"), low(0.95).alias("fpr_at_tpr_95"))


_HIGHER = "list_sort(list(score) FILTER (failure = 0))[ceil(0.95 * (count(*) FILTER (failure = 0) - 1))::INT + 1]"


def higher_quantile(value: Column, when: Column, q: float) -> Column:
    """The quantile that is the next value up, never an interpolated one."""
    kept = F.array_sort(F.collect_list(F.when(when, value)))
    return kept[F.ceil(F.lit(q) * (F.count_if(when) - 1)).cast("int")]


@query("m9_train_threshold", with_rec("") + LONG + f", t AS (SELECT detector, {_HIGHER} AS threshold FROM lg WHERE dataset <> 'D0' GROUP BY detector) SELECT l.detector, threshold, count_if(score >= threshold AND failure = 1) AS tp, count_if(score >= threshold AND failure = 0) AS fp, count_if(score < threshold AND failure = 0) AS tn, count_if(score < threshold AND failure = 1) AS fn FROM lg l JOIN t ON l.detector = t.detector WHERE dataset = 'D0' GROUP BY ALL")
def train_threshold(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d)
    t = rows.filter("dataset <> 'D0'").groupBy("detector").agg(higher_quantile(F.col("score"), F.col("failure") == 0, 0.95).alias("threshold"))
    alarm, bad = F.col("score") >= F.col("threshold"), F.col("failure") == 1
    return rows.filter("dataset = 'D0'").join(t, "detector").groupBy("detector", "threshold").agg(F.count_if(alarm & bad).alias("tp"), F.count_if(alarm & ~bad).alias("fp"), F.count_if(~alarm & ~bad).alias("tn"), F.count_if(~alarm & bad).alias("fn"))


def leave_out(rows: DataFrame, group: str) -> DataFrame:
    """detector, heldout, threshold, f1, n, failures: the threshold of the best F1 on all other groups, evaluated at or above it."""
    names = rows.select(F.col(group).alias("heldout")).distinct()
    train = rows.join(F.broadcast(names), F.col(group) != F.col("heldout"))  # a handful of groups
    t = best_f1(train, ["detector", "heldout"]).select("detector", "heldout", F.col("best_threshold").alias("threshold"))
    test = rows.withColumn("heldout", F.col(group)).join(t, ["detector", "heldout"])
    alarm, bad = F.col("score") >= F.col("threshold"), F.col("failure") == 1
    c = test.groupBy("detector", "heldout", "threshold").agg(F.count_if(alarm & bad).alias("tp"), F.count_if(alarm & ~bad).alias("fp"), F.sum("failure").alias("failures"), F.count(F.lit(1)).alias("n"))
    score = F.when(2 * F.col("tp") + F.col("fp") + F.col("failures") - F.col("tp") > 0, 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("failures"))).otherwise(0.0)
    return c.select("detector", "heldout", "threshold", rounded(score).alias("f1"), "n", "failures")


def _leave_sql(group: str) -> str:
    return LONG + f""", h AS (SELECT DISTINCT {group} AS heldout FROM rec),
c0 AS (SELECT detector, heldout, score, sum(failure) AS dp, sum(1 - failure) AS dn FROM lg JOIN h ON lg.{group} <> h.heldout GROUP BY ALL),
c1 AS (SELECT *, sum(dp) OVER w AS tp, sum(dn) OVER w AS fp, sum(dp) OVER (PARTITION BY detector, heldout) AS p FROM c0 WINDOW w AS (PARTITION BY detector, heldout ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT detector, heldout, score AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY detector, heldout ORDER BY round({_F1}, 12) DESC, score) AS k FROM c1 WHERE p > 0) WHERE k = 1),
e AS (SELECT lg.detector, t.heldout, t.threshold, count_if(score >= threshold AND failure = 1) AS tp, count_if(score >= threshold AND failure = 0) AS fp, sum(failure) AS failures, count(*) AS n FROM lg JOIN t ON lg.detector = t.detector AND lg.{group} = t.heldout GROUP BY ALL)
SELECT detector, heldout, threshold, round(CASE WHEN tp + fp + failures > 0 THEN 2 * tp / (tp + fp + failures) ELSE 0 END, 6) AS f1, n, failures FROM e"""


@query("m10_leave_perturbation_out", with_rec("") + _leave_sql("perturbation"))
def lopo(spark: SparkSession, d: str) -> DataFrame:
    return leave_out(scored(spark, d), "perturbation")


@query("m11_leave_dataset_out", with_rec("") + _leave_sql("dataset"))
def lodo(spark: SparkSession, d: str) -> DataFrame:
    return leave_out(scored(spark, d), "dataset")


@query("m12_detector_correlation", with_rec("") + LONG + " SELECT detector, count(*) AS n, round(corr(score, acc_drop), 6) AS r_vs_drop FROM lg GROUP BY detector")
def detector_correlation(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("detector").agg(F.count(F.lit(1)).alias("n"), rounded(correlation("score", "acc_drop")).alias("r_vs_drop"))
