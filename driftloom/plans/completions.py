"""Full forms of analyses whose first parts stand in their own families: margins (K13), dissociation (L13), transfer, cross-space and tier summaries (N9, N19-N22), recomputed records (V3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.functions.vectors import dot, sum_vector
from driftloom.operators.resampling import bootstrap_rows
from driftloom.plans import recognition
from driftloom.plans.base import DIM, correlation, neighbour_lists, paired, records, rounded, sql_mean, with_near, with_rec, with_units
from driftloom.plans.metrics import auc
from driftloom.plans.relational import average_rank
from driftloom.plans.resampling import boot_sql
from driftloom.plans.statistics import partial_r
from driftloom.registry import query

KEY = ["dataset", "backbone", "tag"]
#: What a dataset stands for where ratios of magnifications are asked for.
SCALE = {"D0": 10, "D1": 20, "D2": 50}
REPLICATES = 10_000


def _average_rank_sql(c: str, keys: str = "") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    return f"rank() OVER ({part}ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys + ', ' if keys else ''}{c}) - 1) / 2.0"


# ---- K13 ----


def _auc_of(score: str) -> str:
    return f"(sum(CASE WHEN flip = 1 THEN {score} END) - sum(flip) * (sum(flip) + 1) / 2.0) / (sum(flip) * sum(1 - flip))"


@query("k13_margin_auc", with_units("") + recognition.SCORES + """, j AS (SELECT s.perturbation, (s.margin <= 0)::INT AS flip, 1 - p.cos AS drift, k.margin + (list_dot_product(p.u, a.c) - list_dot_product(p.c, a.c)) - (list_dot_product(p.u, b.c) - list_dot_product(p.c, b.c)) AS pm
 FROM mg s JOIN mg k ON k.dataset = s.dataset AND k.backbone = s.backbone AND k.vec_id = s.vec_id AND k.tag = 'clean_0' JOIN pairs p ON p.dataset = s.dataset AND p.backbone = s.backbone AND p.tag = s.tag AND p.vec_id = s.vec_id
 JOIN cc a ON a.dataset = s.dataset AND a.backbone = s.backbone AND a.class = s.label JOIN cc b ON b.dataset = s.dataset AND b.backbone = s.backbone AND b.class = k.rival WHERE s.tag <> 'clean_0' AND k.margin > 0),
l AS (SELECT level, flip, round(drift, 12) AS drift, round(-pm, 12) AS erosion, pm FROM j, (VALUES ('all'), ('own')) v(w), LATERAL (SELECT CASE w WHEN 'all' THEN 'all' ELSE perturbation END AS level) x),
r AS (SELECT *, """ + _average_rank_sql("drift", "level") + " AS rd, " + _average_rank_sql("erosion", "level") + " AS re FROM l) SELECT level, count(*) AS n, sum(flip)::BIGINT AS flips, round(" + _auc_of("rd") + ", 6) AS auc_total_drift, round(" + _auc_of("re") + ", 6) AS auc_pred_margin, round(avg(CASE WHEN flip = 1 THEN (pm <= 0)::DOUBLE END), 6) AS firstorder_recall FROM r GROUP BY level HAVING sum(flip) > 0 AND sum(flip) < count(*)")
def margin_auc(spark: SparkSession, d: str) -> DataFrame:
    """How well the first-order margin, and the drift alone, tell which samples flip: over all conditions and by perturbation."""
    j = recognition.first_order(spark, d).select("perturbation", (F.col("margin") <= 0).cast("int").alias("failure"), F.round("drift", 12).alias("drift"), F.round(-F.col("p"), 12).alias("erosion"), "p")
    rows = j.withColumn("level", F.explode(F.array(F.lit("all"), F.col("perturbation"))))
    area = lambda c: auc(rows.withColumn("score", F.col(c)), ["level"]).select("level", rounded(F.col("auc")).alias(f"auc_{c}"))
    recall = rounded(F.avg(F.when(F.col("failure") == 1, (F.col("p") <= 0).cast("double")))).alias("firstorder_recall")
    base = rows.groupBy("level").agg(F.count("*").alias("n"), F.sum("failure").alias("flips"), recall)
    out = base.join(area("drift"), "level").join(area("erosion"), "level")
    return out.select("level", "n", "flips", F.col("auc_drift").alias("auc_total_drift"), F.col("auc_erosion").alias("auc_pred_margin"), "firstorder_recall")


# ---- L13 ----

_TWO = "(s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12)", "(s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12)"


@query("l13_dissociation_full", with_near("SELECT 1")[: -len("\nSELECT 1")] + f""", sc AS (SELECT dataset, backbone, tag, avg(CASE WHEN rank <= 5 THEN 1 - sim END) AS m, avg(CASE WHEN rank = 1 THEN (near_label = label)::DOUBLE END) AS a FROM near GROUP BY ALL),
sm AS (SELECT dataset, backbone, tag, count(*) AS n, {sql_mean('u')} AS c FROM su GROUP BY ALL),
g AS (SELECT sc.tag, avg(m) AS m, avg(k.a - sc.a) AS f, avg(1 - (n * list_dot_product(c, c) - 1) / (n - 1)) AS cp FROM sc JOIN (SELECT dataset, backbone, a FROM (SELECT dataset, backbone, tag, avg(CASE WHEN rank = 1 THEN (near_label = label)::DOUBLE END) AS a FROM near GROUP BY ALL) WHERE tag = 'clean_0') k USING (dataset, backbone) JOIN sm USING (dataset, backbone, tag) GROUP BY sc.tag),
rk AS (SELECT *, row_number() OVER (ORDER BY m, tag) AS rm, row_number() OVER (ORDER BY f, tag) AS rf, max(CASE WHEN tag = 'clean_0' THEN m END) OVER () AS m0 FROM g),
cv AS (SELECT count(*) AS conditions, avg(CASE WHEN tag <> 'clean_0' THEN (m > m0)::DOUBLE END) AS detect_rate, corr(rm, rf) AS rho, regr_r2(f, m) AS r2, var_samp(m) AS s11, var_samp(cp) AS s22, covar_samp(m, cp) AS s12, covar_samp(m, f) AS s1y, covar_samp(cp, f) AS s2y, var_samp(f) AS syy FROM rk)
SELECT conditions, round(detect_rate, 6) AS detect_rate, round(rho, 6) AS severity_spearman, round(r2, 6) AS r2_score_only, round(({_TWO[0]} * s1y + {_TWO[1]} * s2y) / syy, 5) AS r2_with_spread, round({_TWO[0]}, 4) AS beta_score, round({_TWO[1]}, 4) AS beta_spread FROM cv""")
def dissociation_full(spark: SparkSession, d: str) -> DataFrame:
    """Does a detector's score rise with the failure? Share of conditions above the clean score, rank correlation, and what the batch's own spread adds."""
    near = neighbour_lists(spark, d).groupBy(*KEY).agg(F.avg(F.when(F.col("rank") <= 5, 1 - F.col("sim"))).alias("m"), F.avg(F.when(F.col("rank") == 1, (F.col("near_label") == F.col("label")).cast("double"))).alias("a"))
    clean = near.filter("tag = 'clean_0'").select("dataset", "backbone", F.col("a").alias("a0"))
    sums = paired(spark, d).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), sum_vector(F.col("u"), DIM).alias("s"))
    spread = sums.select(*KEY, (1 - (dot(F.col("s"), F.col("s"), DIM) / F.col("n") - 1) / (F.col("n") - 1)).alias("cp"))
    g = near.join(clean, ["dataset", "backbone"]).join(spread, KEY).groupBy("tag").agg(F.avg("m").alias("m"), F.avg(F.col("a0") - F.col("a")).alias("f"), F.avg("cp").alias("cp"))
    order = lambda c: F.row_number().over(Window.orderBy(c, "tag"))  # noqa: E731  a row for each condition
    g = g.withColumns({"rm": order("m"), "rf": order("f"), "m0": F.max(F.when(F.col("tag") == "clean_0", F.col("m"))).over(Window.partitionBy())})
    cv = g.agg(
        F.count("*").alias("conditions"), F.avg(F.when(F.col("tag") != "clean_0", (F.col("m") > F.col("m0")).cast("double"))).alias("detect_rate"), correlation("rm", "rf").alias("rho"), F.regr_r2("f", "m").alias("r2"),
        F.var_samp("m").alias("s11"), F.var_samp("cp").alias("s22"), F.covar_samp("m", "cp").alias("s12"), F.covar_samp("m", "f").alias("s1y"), F.covar_samp("cp", "f").alias("s2y"), F.var_samp("f").alias("syy"),
    )
    b1, b2 = (F.expr(x) for x in _TWO)
    both = (b1 * F.col("s1y") + b2 * F.col("s2y")) / F.col("syy")
    return cv.select("conditions", rounded(F.col("detect_rate")).alias("detect_rate"), rounded(F.col("rho")).alias("severity_spearman"), rounded(F.col("r2")).alias("r2_score_only"), rounded(both, 5).alias("r2_with_spread"), rounded(b1, 4).alias("beta_score"), rounded(b2, 4).alias("beta_spread"))


# ---- N9, N19, N21, N22 ----


@query("n9_lodo_rho", with_rec("""SELECT heldout, count(*) AS n, round(corr(ry, rp), 6) AS rho FROM (SELECT heldout, """ + _average_rank_sql("y", "heldout") + " AS ry, " + _average_rank_sql("p", "heldout") + """ AS rp FROM (SELECT t.dataset AS heldout, t.acc_drop AS y, round(m.a + m.b * t.drift, 9) AS p
FROM rec t JOIN (SELECT h.dataset, regr_intercept(r.acc_drop, r.drift) AS a, regr_slope(r.acc_drop, r.drift) AS b FROM (SELECT DISTINCT dataset FROM rec) h JOIN rec r ON r.dataset <> h.dataset GROUP BY h.dataset) m ON t.dataset = m.dataset)) GROUP BY heldout"""))
def lodo_rho(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of held-out drops with those predicted from the other datasets."""
    r = records(spark, d)
    held = r.select(F.col("dataset").alias("heldout")).distinct()
    model = r.join(F.broadcast(held), F.col("dataset") != F.col("heldout")).groupBy("heldout").agg(F.regr_intercept("acc_drop", "drift").alias("a"), F.regr_slope("acc_drop", "drift").alias("b"))  # the few datasets
    t = r.withColumnRenamed("dataset", "heldout").join(model, "heldout").withColumn("p", F.round(F.col("a") + F.col("b") * F.col("drift"), 9))
    t = t.withColumns({"ry": average_rank("acc_drop", ["heldout"]), "rp": average_rank("p", ["heldout"])})
    return t.groupBy("heldout").agg(F.count("*").alias("n"), rounded(correlation("ry", "rp")).alias("rho"))


def stacked(spark: SparkSession, d: str) -> DataFrame:
    """Every condition's drift in one space beside its drop in another (or the same)."""
    r = records(spark, d)
    a = r.select("dataset", "tag", "perturbation", "severity", F.col("backbone").alias("x"), "drift")
    b = r.select("dataset", "tag", F.col("backbone").alias("y"), "acc_drop")
    return a.join(b, ["dataset", "tag"])


@query("n19_pooled", with_rec("") + ", st AS (SELECT a.backbone AS x, b.backbone AS y, a.drift, b.acc_drop FROM rec a JOIN rec b ON a.dataset = b.dataset AND a.tag = b.tag), m AS (SELECT x, y, corr(drift, acc_drop) AS r FROM st GROUP BY ALL), o AS (SELECT drift, acc_drop, " + _average_rank_sql("drift") + " AS ra, " + _average_rank_sql("acc_drop") + """ AS rb FROM st WHERE x <> y)
SELECT round((SELECT avg(r) FROM m WHERE x = y), 6) AS within_space_mean_r, round((SELECT avg(r) FROM m WHERE x <> y), 6) AS cross_space_mean_r, round((SELECT min(r) FROM m WHERE x <> y), 6) AS cross_space_min_r, round((SELECT max(r) FROM m WHERE x <> y), 6) AS cross_space_max_r, count(*) AS n, round(corr(drift, acc_drop), 6) AS pooled_r, round(corr(ra, rb), 6) AS pooled_rho FROM o""")
def pooled(spark: SparkSession, d: str) -> DataFrame:
    """The matrix of drift in one space against drop in another, summed up, and all pairs of different spaces pooled."""
    st = stacked(spark, d)
    m = st.groupBy("x", "y").agg(correlation("drift", "acc_drop").alias("r"))
    cross = F.when(F.col("x") != F.col("y"), F.col("r"))
    m = m.agg(rounded(F.avg(F.when(F.col("x") == F.col("y"), F.col("r")))).alias("within_space_mean_r"), rounded(F.avg(cross)).alias("cross_space_mean_r"), rounded(F.min(cross)).alias("cross_space_min_r"), rounded(F.max(cross)).alias("cross_space_max_r"))
    off = st.filter("x <> y").withColumns({"ra": average_rank("drift", []), "rb": average_rank("acc_drop", [])})
    return m.crossJoin(off.agg(F.count("*").alias("n"), rounded(correlation("drift", "acc_drop")).alias("pooled_r"), rounded(correlation("ra", "rb")).alias("pooled_rho")))  # one row each


@query("n19_partial")
def cross_partial(spark: SparkSession, d: str) -> DataFrame:
    """Drift in one space against drop in another, controlled for dataset, perturbation and severity."""
    r, n = partial_r(stacked(spark, d).filter("x <> y"), "drift", "acc_drop", ("dataset", "perturbation", "severity"))
    return spark.createDataFrame([("dataset+perturbation+severity", n, round(r, 6))], "controls string, n long, partial_r double")


_K8 = with_units("") + recognition.TRANSFER + f", tm AS (SELECT source, target, backbone, avg((predicted = label)::DOUBLE) AS accuracy FROM {recognition.TV} GROUP BY ALL)"


def transfers(spark: SparkSession, d: str) -> DataFrame:
    return recognition.transfer_votes(spark, d).groupBy("source", "target", "backbone").agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"))


_PAIRS = [("D0", "D1"), ("D0", "D2"), ("D1", "D2")]


@query("n21_pair_pivot", _K8 + " SELECT backbone, " + ", ".join(f"round(max(CASE WHEN source = '{a}' AND target = '{b}' THEN accuracy END), 6) AS {a}_{b}, round(max(CASE WHEN source = '{b}' AND target = '{a}' THEN accuracy END), 6) AS {b}_{a}, round(max(CASE WHEN source = '{a}' AND target = '{b}' THEN accuracy END) - max(CASE WHEN source = '{b}' AND target = '{a}' THEN accuracy END), 6) AS {a}_{b}_asymmetry" for a, b in _PAIRS) + " FROM tm GROUP BY backbone")
def pair_pivot(spark: SparkSession, d: str) -> DataFrame:
    """One row for each space: accuracy in both directions of every pair of datasets, and their difference."""
    at = lambda a, b: F.max(F.when((F.col("source") == a) & (F.col("target") == b), F.col("accuracy")))
    cols = [c for a, b in _PAIRS for c in (rounded(at(a, b)).alias(f"{a}_{b}"), rounded(at(b, a)).alias(f"{b}_{a}"), rounded(at(a, b) - at(b, a)).alias(f"{a}_{b}_asymmetry"))]
    return transfers(spark, d).groupBy("backbone").agg(*cols)


@query("n22_by_perturbation", with_rec("SELECT perturbation, count(*) AS n, round(corr(a, b), 6) AS r FROM (SELECT perturbation, backbone, tag, avg(CASE WHEN dataset <> 'D2' THEN acc_drop END) AS a, avg(CASE WHEN dataset = 'D2' THEN acc_drop END) AS b FROM rec GROUP BY ALL) GROUP BY perturbation"))
def tiers_by_perturbation(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the two tiers' drops over spaces and severities, for each perturbation."""
    of = lambda c: F.avg(F.when(c, F.col("acc_drop")))
    m = records(spark, d).groupBy("perturbation", "backbone", "tag").agg(of(F.col("dataset") != "D2").alias("a"), of(F.col("dataset") == "D2").alias("b"))
    return m.groupBy("perturbation").agg(F.count("*").alias("n"), rounded(correlation("a", "b")).alias("r"))


# ---- N20 ----

_BOTH = ", bp AS (SELECT a.backbone, a.source AS coarse, a.target AS fine, a.accuracy AS up, b.accuracy AS down FROM tm a JOIN tm b ON a.backbone = b.backbone AND a.source = b.target AND a.target = b.source WHERE a.source < a.target)"


def directions(spark: SparkSession, d: str) -> DataFrame:
    """backbone, coarse, fine, up (accuracy from coarse to fine), down."""
    t = transfers(spark, d).filter("source <> target")
    up = t.filter("source < target").select("backbone", F.col("source").alias("coarse"), F.col("target").alias("fine"), F.col("accuracy").alias("up"))
    down = t.filter("source > target").select("backbone", F.col("target").alias("coarse"), F.col("source").alias("fine"), F.col("accuracy").alias("down"))
    return up.join(down, ["backbone", "coarse", "fine"])


def _easier(x: Column) -> Column:
    return F.when(F.abs(x) < 0.02, "near_symmetric").when(x > 0, "coarse_to_fine_easier").otherwise("fine_to_coarse_easier")


_EASIER = "CASE WHEN abs({x}) < 0.02 THEN 'near_symmetric' WHEN {x} > 0 THEN 'coarse_to_fine_easier' ELSE 'fine_to_coarse_easier' END"


@query("n20_pair_asymmetry", _K8 + _BOTH + ", sg AS (SELECT coarse, fine, backbone, up, down, round(up - down, 9) AS asym FROM bp), md AS (SELECT coarse, fine, CASE WHEN count_if(asym > 0) = 0 AND count_if(asym < 0) = 0 THEN 0 WHEN count_if(asym < 0) >= count_if(asym > 0) THEN -1 ELSE 1 END AS modal FROM sg GROUP BY ALL)\nSELECT coarse || '<->' || fine AS pair, count(*) AS spaces, round(avg(up), 6) AS mean_up, round(avg(down), 6) AS mean_down, round(avg(asym), 6) AS signed_asymmetry, " + _EASIER.format(x="avg(asym)") + " AS easier_direction, round(CASE WHEN any_value(modal) = 0 THEN avg((abs(asym) < 0.02)::DOUBLE) ELSE avg((sign(asym) = modal)::DOUBLE) END, 6) AS sign_agreement FROM sg JOIN md USING (coarse, fine) GROUP BY coarse, fine")
def pair_asymmetry(spark: SparkSession, d: str) -> DataFrame:
    """For each pair of datasets: both directions over the spaces, which is easier, and how many spaces agree on the sign (of equal counts the negative one)."""
    b = directions(spark, d).withColumn("asym", F.round(F.col("up") - F.col("down"), 9))
    plus, minus = F.count_if(F.col("asym") > 0), F.count_if(F.col("asym") < 0)
    modal = b.groupBy("coarse", "fine").agg(F.when((plus == 0) & (minus == 0), 0).when(minus >= plus, -1).otherwise(1).alias("modal"))
    g = b.join(modal, ["coarse", "fine"]).groupBy("coarse", "fine", "modal")
    agree = F.when(F.col("modal") == 0, F.avg((F.abs("asym") < 0.02).cast("double"))).otherwise(F.avg((F.signum("asym") == F.col("modal")).cast("double")))
    return g.agg(F.count("*").alias("spaces"), rounded(F.avg("up")).alias("mean_up"), rounded(F.avg("down")).alias("mean_down"), rounded(F.avg("asym")).alias("signed_asymmetry"), _easier(F.avg("asym")).alias("easier_direction"), rounded(agree).alias("sign_agreement")).select(F.concat_ws("<->", "coarse", "fine").alias("pair"), "spaces", "mean_up", "mean_down", "signed_asymmetry", "easier_direction", "sign_agreement")


def _ci(rows: DataFrame, keys: list[str], value: str, seed: str) -> DataFrame:
    """Percentile interval of the mean over spaces, by resampling them: a handful of rows for each key."""
    means = bootstrap_rows(rows, keys, ["backbone"], REPLICATES, seed).groupBy(*keys, "replicate").agg(F.avg(value).alias("m"))
    return means.groupBy(*keys).agg(rounded(F.percentile("m", F.lit(0.025)), 5).alias("ci_lo"), rounded(F.percentile("m", F.lit(0.975)), 5).alias("ci_hi"))


_RATIO = "CASE fine " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SCALE.items()) + " END / CASE coarse " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SCALE.items()) + " END"


@query("n20_ratio_summary", _K8 + _BOTH + ", bi AS (SELECT coarse || '<->' || fine AS pair, coarse, fine, backbone, (up + down) / 2 AS two_way, abs(up - down) AS gap FROM bp), " + boot_sql("bi", "pair", "backbone", "ratio", REPLICATES) + f", ci AS (SELECT pair, round(quantile_cont(m, 0.025), 5) AS ci_lo, round(quantile_cont(m, 0.975), 5) AS ci_hi FROM (SELECT pair, replicate, avg(two_way) AS m FROM boot GROUP BY ALL) GROUP BY pair)\nSELECT pair, ({_RATIO})::DOUBLE AS ratio, round(avg(two_way), 6) AS mean_bidirectional, round(avg(gap), 6) AS mean_abs_asymmetry, any_value(ci_lo) AS ci_lo, any_value(ci_hi) AS ci_hi FROM bi JOIN ci USING (pair) GROUP BY pair, coarse, fine")
def ratio_summary(spark: SparkSession, d: str) -> DataFrame:
    """Transfer in both directions by the ratio of scales, with an interval over resampled spaces."""
    b = directions(spark, d).select("backbone", F.concat_ws("<->", "coarse", "fine").alias("pair"), "coarse", "fine", ((F.col("up") + F.col("down")) / 2).alias("both"), F.abs(F.col("up") - F.col("down")).alias("gap"))
    scale = F.create_map(*[F.lit(x) for kv in SCALE.items() for x in kv])
    means = b.groupBy("pair", "coarse", "fine").agg(rounded(F.avg("both")).alias("mean_bidirectional"), rounded(F.avg("gap")).alias("mean_abs_asymmetry"))
    return means.select("pair", (scale[F.col("fine")] / scale[F.col("coarse")]).cast("double").alias("ratio"), "mean_bidirectional", "mean_abs_asymmetry").join(_ci(b, ["pair"], "both", "ratio"), "pair")


@query("n20_nonmonotone", _K8 + _BOTH + ", df AS (SELECT 'D0<->D2_minus_D1<->D2' AS comparison, a.backbone, (a.up + a.down) / 2 - (b.up + b.down) / 2 AS diff FROM bp a JOIN bp b ON a.backbone = b.backbone WHERE a.coarse = 'D0' AND a.fine = 'D2' AND b.coarse = 'D1' AND b.fine = 'D2'), " + boot_sql("df", "comparison", "backbone", "mono", REPLICATES) + ", ci AS (SELECT comparison, round(quantile_cont(m, 0.025), 5) AS ci_lo, round(quantile_cont(m, 0.975), 5) AS ci_hi FROM (SELECT comparison, replicate, avg(diff) AS m FROM boot GROUP BY ALL) GROUP BY comparison) SELECT comparison, count(*) AS spaces, round(avg(diff), 6) AS mean_difference, any_value(ci_lo) AS ci_lo, any_value(ci_hi) AS ci_hi FROM df JOIN ci USING (comparison) GROUP BY comparison")
def nonmonotone(spark: SparkSession, d: str) -> DataFrame:
    """Is the pair of the largest ratio better than a nearer one? Paired difference over spaces, with an interval."""
    both = directions(spark, d).withColumn("both", (F.col("up") + F.col("down")) / 2)
    far = both.filter("coarse = 'D0' AND fine = 'D2'").select("backbone", F.col("both").alias("far"))
    near = both.filter("coarse = 'D1' AND fine = 'D2'").select("backbone", F.col("both").alias("near"))
    rows = far.join(near, "backbone").select(F.lit("D0<->D2_minus_D1<->D2").alias("comparison"), "backbone", (F.col("far") - F.col("near")).alias("diff"))
    return rows.groupBy("comparison").agg(F.count("*").alias("spaces"), rounded(F.avg("diff")).alias("mean_difference")).join(_ci(rows, ["comparison"], "diff", "mono"), "comparison")


# ---- V3 ----


@query("v3_from_rows", with_rec("") + """, a AS (SELECT dataset, backbone, tag, avg(ok) AS accuracy, avg(far) AS knn1 FROM (SELECT dataset, backbone, tag, vec_id, arg_min((near_label = label)::DOUBLE, rank) AS ok, 1 - max(sim) AS far FROM near GROUP BY ALL) GROUP BY ALL), b AS (SELECT dataset, backbone, tag, avg(1 - list_dot_product(u, c)) AS drift FROM pairs GROUP BY ALL)
SELECT rec.dataset, count(*) AS n, count_if(abs(rec.accuracy - a.accuracy) > 1e-8) AS wrong_accuracy, count_if(abs(rec.knn1 - a.knn1) > 1e-8) AS wrong_knn1, count_if(abs(rec.drift - greatest(b.drift, 0)) > 1e-8) AS wrong_drift, count_if(abs(rec.acc_drop - (k.accuracy - a.accuracy)) > 1e-8) AS wrong_drop, count_if(rec.failure <> (round(k.accuracy - a.accuracy, 9) > 0.2)::INT) AS wrong_failure
FROM rec JOIN a USING (dataset, backbone, tag) JOIN b USING (dataset, backbone, tag) JOIN a k ON k.dataset = rec.dataset AND k.backbone = rec.backbone AND k.tag = 'clean_0' GROUP BY rec.dataset""")
def from_rows(spark: SparkSession, d: str) -> DataFrame:
    """Written records held against neighbour lists and paired rows again: how many of each formula's values are off by more than 1e-8."""
    first = neighbour_lists(spark, d).groupBy(*KEY, "vec_id").agg(F.min_by((F.col("near_label") == F.col("label")).cast("double"), "rank").alias("ok"), (1 - F.max("sim")).alias("far"))
    a = first.groupBy(*KEY).agg(F.avg("ok").alias("a"), F.avg("far").alias("k"))
    b = paired(spark, d).groupBy(*KEY).agg(F.avg(1 - dot(F.col("u"), F.col("c"), DIM)).alias("b"))
    clean = a.filter("tag = 'clean_0'").select("dataset", "backbone", F.col("a").alias("a0"))
    r = records(spark, d).join(a, KEY).join(b, KEY).join(clean, ["dataset", "backbone"])
    off = lambda x, y: F.count_if(F.abs(F.col(x) - y) > 1e-8)
    drop = F.col("a0") - F.col("a")
    return r.groupBy("dataset").agg(F.count("*").alias("n"), off("accuracy", F.col("a")).alias("wrong_accuracy"), off("knn1", F.col("k")).alias("wrong_knn1"), off("drift", F.greatest("b", F.lit(0.0))).alias("wrong_drift"), off("acc_drop", drop).alias("wrong_drop"), F.count_if(F.col("failure") != (F.round(drop, 9) > 0.2).cast("int")).alias("wrong_failure"))
