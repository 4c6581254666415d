"""Queries of the statistics family (N)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.functions import tails
from driftloom.functions.names import significance
from driftloom.operators.mixed import crossed
from driftloom.operators.regression import dummies, levels, products, residual_products, solve, unpack
from driftloom.plans.base import correlation, records, rounded, with_rec
from driftloom.plans.relational import average_rank, avg6, ordinal
from driftloom.registry import query

FACTORS = ("dataset", "backbone", "perturbation", "severity")


def pearson_p(r: str, n: str) -> Column:
    """p of a correlation; one row for each group, after the aggregate."""
    return F.udf(lambda a, b: None if a is None or b is None else tails.pearson_p(a, b), "double")(r, n)


@query("n1_pearson", with_rec("SELECT count(*) AS n, round(corr(drift, acc_drop), 6) AS r FROM rec"))
def pearson(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).agg(F.count("*").alias("n"), rounded(correlation("drift", "acc_drop")).alias("r"))


@query("n1_pearson_p")
def pearson_with_p(spark: SparkSession, d: str) -> DataFrame:
    g = records(spark, d).groupBy("backbone").agg(F.count("*").alias("n"), correlation("drift", "acc_drop").alias("r"))
    return g.withColumn("p", pearson_p("r", "n")).withColumn("stars", significance(F.col("p")))


_AR = lambda c, k="": f"rank() OVER ({k}ORDER BY {c}) + (count(*) OVER (PARTITION BY {(k.replace('PARTITION BY ', '').strip() + ', ') if k else ''}{c}) - 1) / 2.0"


@query("n2_spearman", with_rec(f"SELECT round(corr(a, b), 6) AS rho FROM (SELECT {_AR('drift')} AS a, {_AR('acc_drop')} AS b FROM rec)"))
def spearman(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).withColumns({"a": average_rank("drift", []), "b": average_rank("acc_drop", [])})
    return r.agg(rounded(correlation("a", "b")).alias("rho"))


@query("n3_grouped_pearson", with_rec("SELECT perturbation, count(*) AS n, round(corr(drift, acc_drop), 6) AS r FROM rec GROUP BY perturbation HAVING count(*) >= 20"))
def grouped_pearson(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).groupBy("perturbation").agg(F.count("*").alias("n"), rounded(correlation("drift", "acc_drop")).alias("r")).filter("n >= 20")


@query("n4_partial_one_factor", with_rec("SELECT round(corr(a, b), 6) AS partial_r FROM (SELECT drift - avg(drift) OVER (PARTITION BY perturbation) AS a, acc_drop - avg(acc_drop) OVER (PARTITION BY perturbation) AS b FROM rec)"))
def partial_one(spark: SparkSession, d: str) -> DataFrame:
    """Demeaning by group is the residual of one-factor least squares."""
    w = Window.partitionBy("perturbation")
    r = records(spark, d).select(*[(F.col(c) - F.avg(c).over(w)).alias(c) for c in ("drift", "acc_drop")])
    return r.agg(rounded(correlation("drift", "acc_drop")).alias("partial_r"))


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def partial_r(rows: DataFrame, x: str, y: str, factors: tuple[str, ...]) -> tuple[float, int]:
    """Correlation of x and y after regression on one-hot factors, from one aggregate of sums of products."""
    f = dummies(levels(rows, factors))
    got = products(rows, [*f, F.col(x), F.col(y)]).first()
    s = residual_products(unpack(got["xx"], len(f) + 2), len(f))
    return float(s[0, 1] / math.sqrt(s[0, 0] * s[1, 1])), got["n"]


@query("n5_partial_factors")
def partial_factors(spark: SparkSession, d: str) -> DataFrame:
    """Sets of one to four factors; the full design is rank-deficient, which the pseudo-inverse allows for."""
    r = records(spark, d)
    out = [("+".join(FACTORS[:k]), *partial_r(r, "drift", "acc_drop", FACTORS[:k])) for k in range(1, 5)]
    return _frame(spark, [(c, round(v, 6), n) for c, v, n in out], "controls string, partial_r double, n long")


@query("n6_hierarchical_r2")
def hierarchical_r2(spark: SparkSession, d: str) -> DataFrame:
    """R2 of growing models and the step each adds, all from one aggregate."""
    r = records(spark, d)
    lv = levels(r, FACTORS[:3])
    f = dummies(lv)
    blocks = [("controls", len(f)), ("+ drift", len(f) + 1), ("+ knn5", len(f) + 2)]
    xx = unpack(products(r, [*f, F.col("drift"), F.col("knn5"), F.col("acc_drop")]).first()["xx"], len(f) + 3)
    y = len(f) + 2
    total = xx[y, y] - xx[0, y] ** 2 / xx[0, 0]
    rows, last = [], 0.0
    for name, k in blocks:
        some = [*range(k), y]
        _, rss, _, _ = solve(xx[np.ix_(some, some)], k)
        r2 = 1 - rss / total
        rows.append((name, round(float(r2), 6), round(float(r2 - last), 6)))
        last = r2
    return _frame(spark, rows, "model string, r2 double, delta double")


@query("n7_subset_sensitivity", with_rec("SELECT 'all' AS subset, count(*) AS n, round(corr(drift, acc_drop), 6) AS r, round(avg(acc_drop), 6) AS mean_drop FROM rec UNION ALL SELECT 'complete', count(*), round(corr(drift, acc_drop), 6), round(avg(acc_drop), 6) FROM rec WHERE drift > 0.01"))
def subset_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    which = F.explode(F.when(F.col("drift") > 0.01, F.array(F.lit("all"), F.lit("complete"))).otherwise(F.array(F.lit("all")))).alias("subset")
    return r.select("drift", "acc_drop", which).groupBy("subset").agg(F.count("*").alias("n"), rounded(correlation("drift", "acc_drop")).alias("r"), avg6("acc_drop").alias("mean_drop"))


@query("n8_simple_ols", with_rec("SELECT backbone, round(regr_slope(acc_drop, drift), 6) AS slope, round(regr_intercept(acc_drop, drift), 6) AS intercept, round(regr_r2(acc_drop, drift), 6) AS r2, round(sqrt((1 - regr_r2(acc_drop, drift)) * regr_syy(acc_drop, drift) / (count(*) - 2) / regr_sxx(acc_drop, drift)), 6) AS se FROM rec GROUP BY backbone"))
def simple_ols(spark: SparkSession, d: str) -> DataFrame:
    y, x = F.col("acc_drop"), F.col("drift")
    se = F.sqrt((1 - F.regr_r2(y, x)) * F.regr_syy(y, x) / (F.count("*") - 2) / F.regr_sxx(y, x))
    return records(spark, d).groupBy("backbone").agg(rounded(F.regr_slope(y, x)).alias("slope"), rounded(F.regr_intercept(y, x)).alias("intercept"), rounded(F.regr_r2(y, x)).alias("r2"), rounded(se).alias("se"))


@query("n9_lodo_regression", with_rec("""SELECT t.dataset AS heldout, count(*) AS n, round(sqrt(avg(power(t.acc_drop - (m.a + m.b * t.drift), 2))), 6) AS rmse, round(avg(abs(t.acc_drop - (m.a + m.b * t.drift))), 6) AS mae, round(corr(t.acc_drop, m.a + m.b * t.drift), 6) AS r
FROM rec t JOIN (SELECT h.dataset, regr_intercept(r.acc_drop, r.drift) AS a, regr_slope(r.acc_drop, r.drift) AS b FROM (SELECT DISTINCT dataset FROM rec) h JOIN rec r ON r.dataset <> h.dataset GROUP BY h.dataset) m ON t.dataset = m.dataset GROUP BY t.dataset"""))
def lodo_regression(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    held = r.select(F.col("dataset").alias("heldout")).distinct()
    model = r.join(F.broadcast(held), F.col("dataset") != F.col("heldout")).groupBy("heldout").agg(F.regr_intercept("acc_drop", "drift").alias("a"), F.regr_slope("acc_drop", "drift").alias("b"))  # a handful of groups
    t = r.withColumnRenamed("dataset", "heldout").join(model, "heldout").withColumn("p", F.col("a") + F.col("b") * F.col("drift")).withColumn("e", F.col("acc_drop") - F.col("p"))
    return t.groupBy("heldout").agg(F.count("*").alias("n"), rounded(F.sqrt(F.avg(F.col("e") * F.col("e")))).alias("rmse"), rounded(F.avg(F.abs("e"))).alias("mae"), rounded(correlation("acc_drop", "p")).alias("r"))


@query("n10_fixed_effects")
def fixed_effects(spark: SparkSession, d: str) -> DataFrame:
    """Slope of drift with dataset, backbone and condition effects: standard error, t and p by the pseudo-inverse."""
    r = records(spark, d)
    f = dummies(levels(r, FACTORS))
    got = products(r, [*f, F.col("drift"), F.col("acc_drop")]).first()
    k = len(f) + 1
    beta, rss, inverse, rank = solve(unpack(got["xx"], k + 1), k)
    df = got["n"] - rank
    se = math.sqrt(max(rss, 0) / df * inverse[k - 1, k - 1])
    t = beta[k - 1] / se
    return _frame(spark, [("drift", round(float(beta[k - 1]), 6), round(se, 6), round(float(t), 4), tails.t_two_sided(float(t), df), k, rank)], "term string, slope double, se double, t double, p double, parameters int, rank int")


@query("n12_anova_icc", with_rec("""SELECT round(msb / msw, 6) AS f, round((msb - msw) / (msb + (m - 1) * msw), 6) AS icc, groups, n FROM (
SELECT sum(cnt * power(mean - gm, 2)) / (count(*) - 1) AS msb, sum(ss) / (sum(cnt) - count(*)) AS msw, count(*) AS groups, sum(cnt)::BIGINT AS n, sum(cnt) / count(*) AS m FROM (SELECT backbone, count(*) AS cnt, avg(acc_drop) AS mean, var_pop(acc_drop) * count(*) AS ss FROM rec GROUP BY backbone), (SELECT avg(acc_drop) AS gm FROM rec))"""))
def anova_icc(spark: SparkSession, d: str) -> DataFrame:
    g = records(spark, d).groupBy("backbone").agg(F.count("*").alias("c"), F.avg("acc_drop").alias("m"), (F.var_pop("acc_drop") * F.count("*")).alias("ss"), F.sum("acc_drop").alias("t"))
    # sums of squares about the grand mean from the group sums: no second pass over the rows
    s = g.agg(F.sum(F.col("c") * F.col("m") * F.col("m")).alias("a"), F.sum("t").alias("t"), F.sum("c").alias("n"), F.count("*").alias("groups"), F.sum("ss").alias("within"))
    msb = (F.col("a") - F.col("t") * F.col("t") / F.col("n")) / (F.col("groups") - 1)
    msw = F.col("within") / (F.col("n") - F.col("groups"))
    size = F.col("n") / F.col("groups")
    return s.select(rounded(msb / msw).alias("f"), rounded((msb - msw) / (msb + (size - 1) * msw)).alias("icc"), "groups", "n")


_FR = f"SELECT dataset, tag, backbone, {_AR('accuracy', 'PARTITION BY dataset, tag ')} AS r FROM rec"


@query("n13_friedman", with_rec(f"""SELECT n, k, round((12.0 / (n * k * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - ties / (n * (k * k * k - k))), 5) AS chi2 FROM (SELECT sum(s * s) AS ss, count(*) AS k FROM (SELECT backbone, sum(r) AS s FROM ({_FR}) GROUP BY backbone)),
(SELECT count(DISTINCT (dataset, tag)) AS n FROM rec), (SELECT coalesce(sum(c * c * c - c), 0)::DOUBLE AS ties FROM (SELECT dataset, tag, accuracy, count(*) AS c FROM rec GROUP BY ALL))"""))
def friedman(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    s = r.withColumn("r", average_rank("accuracy", ["dataset", "tag"])).groupBy("backbone").agg(F.sum("r").alias("s"), F.count("*").alias("c"))
    s = s.agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.count("*").alias("k"), F.max("c").alias("n"))
    ties = r.groupBy("dataset", "tag", "accuracy").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"))
    n, k = F.col("n"), F.col("k")
    chi2 = (12.0 / (n * k * (k + 1)) * F.col("ss") - 3 * n * (k + 1)) / (1 - F.col("ties") / (n * (k * k * k - k)))
    return s.crossJoin(ties).select("n", "k", rounded(chi2, 5).alias("chi2"))  # one row each


#: Studentised range at 5 %, divided by the root of 2, for 2 to 10 treatments.
NEMENYI_Q = (1.960, 2.343, 2.569, 2.728, 2.850, 2.949, 3.031, 3.102, 3.164)


@query("n14_nemenyi_cd", with_rec("SELECT n, k, round(2.569::DOUBLE * sqrt(k * (k + 1) / (6.0 * n)), 6) AS cd FROM (SELECT count(DISTINCT (dataset, tag)) AS n, count(DISTINCT backbone) AS k FROM rec)"))
def nemenyi(spark: SparkSession, d: str) -> DataFrame:
    s = records(spark, d).agg(F.countDistinct("dataset", "tag").alias("n"), F.countDistinct("backbone").alias("k"))
    q = F.array(*[F.lit(v) for v in NEMENYI_Q])
    return s.select("n", "k", rounded(F.element_at(q, (F.col("k") - 1).cast("int")) * F.sqrt(F.col("k") * (F.col("k") + 1) / (6.0 * F.col("n")))).alias("cd"))


@query("n14_nemenyi_p")
def nemenyi_p(spark: SparkSession, d: str) -> DataFrame:
    """Mean-rank differences of all pairs with p-values of the studentised range."""
    r = records(spark, d).withColumn("r", average_rank("accuracy", ["dataset", "tag"])).groupBy("backbone").agg(F.avg("r").alias("m"), F.count("*").alias("n"))
    k = F.count("*").over(Window.partitionBy())
    m = r.select("backbone", "m", "n", k.alias("k"))
    a, b = m.withColumnRenamed("backbone", "x"), m.select(F.col("backbone").alias("y"), F.col("m").alias("m2"))
    both = a.join(b, F.col("x") < F.col("y")).withColumn("diff", F.abs(F.col("m") - F.col("m2")))  # the few spaces
    q = F.col("diff") / F.sqrt(F.col("k") * (F.col("k") + 1) / (6.0 * F.col("n"))) * math.sqrt(2)
    p_of = F.udf(lambda v, n: tails.studentised_range_upper(v, n), "double")  # one row for each pair
    return both.select("x", "y", rounded(F.col("diff")).alias("rank_difference"), p_of(q, F.col("k").cast("int")).alias("p"))


@query("n11_mixed_slope")
def mixed_slope(spark: SparkSession, d: str) -> DataFrame:
    """A mixed model with a random intercept and slope of drift for each dataset and space, by expectation-maximisation.

    Rows enter only as sums of products of their group, one aggregate; the iteration runs over those.
    """
    one = F.lit(1.0)
    groups = products(records(spark, d), [one, F.col("drift"), F.col("acc_drop")], ["dataset", "backbone"]).orderBy("dataset", "backbone").collect()  # one row for each group of an experiment
    fit = mixed_model([unpack(g["xx"], 3) for g in groups])
    return _frame(spark, [(len(groups), *(round(float(v), 6) for v in fit))], "groups int, intercept double, slope double, slope_se double, var_intercept double, var_slope double, var_residual double")


@query("n11_crossed_effects")
def crossed_effects(spark: SparkSession, d: str) -> DataFrame:
    """Maximum likelihood of drop on drift and the conditions, with crossed random effects of datasets and spaces.

    One row for each fixed term (estimate, standard error, z, p, 95 % interval) and each variance; severities that a perturbation implies
    make the design rank-deficient, which the solution allows for. Standard errors are those of the terms that the design determines.
    """
    r = records(spark, d)
    lv = levels(r, ("perturbation", "severity"))
    names = ["Intercept", *[f"{c}={v}" for c, values in lv.items() for v in values[1:]], "drift"]
    fit = crossed(r, "acc_drop", dict(zip(names, [*dummies(lv), F.col("drift")], strict=True)), ["dataset", "backbone"])
    rows = []
    for name, b, se in zip(fit.names, fit.beta, fit.se, strict=True):
        z = b / se if se > 1e-12 else None
        rows.append(("fixed", name, round(float(b), 6), round(float(se), 6), None if z is None else tails.normal_two_sided(z), round(float(b - 1.959963985 * se), 6), round(float(b + 1.959963985 * se), 6)))
    rows += [("variance", g, round(float(v), 6), None, None, None, None) for g, v in zip([*fit.groupings, "residual"], [*fit.variances, fit.residual], strict=True)]
    rows.append(("model", "loglike", round(float(fit.loglike), 4), None, None, None, None))
    return _frame(spark, rows, "part string, term string, estimate double, se double, p double, ci_lo double, ci_hi double")


def mixed_model(groups: list[np.ndarray], rounds: int = 500) -> tuple[float, ...]:
    """Maximum likelihood of y = (b0 + u0) + (b1 + u1) x + e from each group's sums of products of (1, x, y)."""
    zz, zy, yy = [g[:2, :2] for g in groups], [g[:2, 2] for g in groups], sum(g[2, 2] for g in groups)
    n = sum(g[0, 0] for g in groups)
    beta = np.linalg.solve(sum(zz), sum(zy))
    s2 = max((yy - beta @ sum(zy)) / n, 1e-9)
    cov = np.eye(2) * s2
    for _ in range(rounds):
        inverse = np.linalg.inv(cov)
        post = [np.linalg.inv(z / s2 + inverse) for z in zz]
        mean = [v @ (y - z @ beta) / s2 for v, z, y in zip(post, zz, zy, strict=True)]
        new = np.linalg.solve(sum(zz), sum(y - z @ u for z, y, u in zip(zz, zy, mean, strict=True)))
        cov = sum(v + np.outer(u, u) for v, u in zip(post, mean, strict=True)) / len(groups) + 1e-12 * np.eye(2)
        rss = 0.0
        for z, y, u, v, g in zip(zz, zy, mean, post, groups, strict=True):
            w = new + u
            rss += g[2, 2] - 2 * w @ y + w @ z @ w + np.trace(z @ v)
        done = np.abs(new - beta).max() < 1e-12
        beta, s2 = new, max(rss / n, 1e-12)
        if done:
            break
    # information about the fixed effects, the random ones integrated out
    info = sum(z / s2 - z @ np.linalg.inv(z / s2 + np.linalg.inv(cov)) @ z / s2**2 for z in zz)
    return beta[0], beta[1], math.sqrt(np.linalg.inv(info)[1, 1]), cov[0, 0], cov[1, 1], s2


_WX = "SELECT a.backbone AS x, b.backbone AS y, a.accuracy - b.accuracy AS diff FROM rec a JOIN rec b ON a.dataset = b.dataset AND a.tag = b.tag AND a.backbone < b.backbone"


@query("n15_wilcoxon", with_rec(f"SELECT x, y, count(*) AS n, least(coalesce(sum(r) FILTER (diff > 0), 0), coalesce(sum(r) FILTER (diff < 0), 0)) AS w FROM (SELECT x, y, diff, {_AR('ad', 'PARTITION BY x, y ')} AS r FROM (SELECT x, y, round(diff, 9) AS diff, round(abs(diff), 9) AS ad FROM ({_WX})) WHERE diff <> 0) GROUP BY x, y"))
def wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    return wilcoxon_pairs(records(spark, d)).select("x", "y", "n", "w")


def wilcoxon_pairs(r: DataFrame) -> DataFrame:
    a = r.select("dataset", "tag", F.col("backbone").alias("x"), F.col("accuracy").alias("u"))
    b = r.select("dataset", "tag", F.col("backbone").alias("y"), F.col("accuracy").alias("v"))
    p = a.join(b, ["dataset", "tag"]).filter("x < y").withColumn("diff", F.round(F.col("u") - F.col("v"), 9)).filter("diff <> 0").withColumn("ad", F.round(F.abs("diff"), 9))
    p = p.withColumn("r", average_rank("ad", ["x", "y"]))
    up, down = (F.coalesce(F.sum(F.when(c, F.col("r"))), F.lit(0.0)) for c in (F.col("diff") > 0, F.col("diff") < 0))
    return p.groupBy("x", "y").agg(F.count("*").alias("n"), F.least(up, down).alias("w"), F.sum(F.col("r") * F.col("r")).alias("rr"))


@query("n15_wilcoxon_p")
def wilcoxon_with_p(spark: SparkSession, d: str) -> DataFrame:
    """Normal approximation with tied ranks' variance, Bonferroni over the pairs."""
    w = wilcoxon_pairs(records(spark, d))
    p_of = F.udf(lambda z: tails.normal_two_sided(z), "double")  # one row for each pair
    z = (F.col("w") - F.col("n") * (F.col("n") + 1) / 4) / F.sqrt(F.col("rr") / 4)
    pairs = F.count("*").over(Window.partitionBy())
    p = w.withColumn("p", p_of(z)).withColumn("p_corrected", F.least(F.col("p") * pairs, F.lit(1.0)))
    return p.select("x", "y", "n", "w", "p", "p_corrected", significance(F.col("p_corrected")).alias("stars"))


@query("n16_kendall_w", with_rec("SELECT n, k, round(12 * (ss - s * s / k) / (n * n * (k * k * k - k)), 6) AS w FROM (SELECT sum(t * t)::DOUBLE AS ss, sum(t)::DOUBLE AS s, count(*) AS k, any_value(n) AS n FROM (SELECT backbone, sum(r) AS t, count(*) AS n FROM (SELECT backbone, row_number() OVER (PARTITION BY dataset, tag ORDER BY accuracy DESC, backbone) AS r FROM rec) GROUP BY backbone))"))
def kendall_w(spark: SparkSession, d: str) -> DataFrame:
    t = records(spark, d).withColumn("r", ordinal("accuracy", ["dataset", "tag"], ["backbone"])).groupBy("backbone").agg(F.sum("r").alias("t"), F.count("*").alias("n"))
    s = t.agg(F.sum(F.col("t") * F.col("t")).alias("ss"), F.sum("t").alias("s"), F.count("*").alias("k"), F.max("n").alias("n"))
    k, n = F.col("k"), F.col("n")
    return s.select("n", "k", rounded(12 * (F.col("ss") - F.col("s") * F.col("s") / k) / (n * n * (k * k * k - k))).alias("w"))


@query("n17_cohens_d", with_rec("SELECT dataset, round(CASE WHEN stddev_pop(diff) < 1e-10 THEN 0 ELSE avg(diff) / stddev_pop(diff) END, 6) AS d FROM (SELECT a.dataset, a.accuracy - b.accuracy AS diff FROM rec a JOIN rec b ON a.dataset = b.dataset AND a.tag = b.tag AND a.backbone = 'B0' AND b.backbone = 'B3') GROUP BY dataset"))
def cohens_d(spark: SparkSession, d: str) -> DataFrame:
    one = lambda b, n: records(spark, d).filter(F.col("backbone") == b).select("dataset", "tag", F.col("accuracy").alias(n))
    diff = one("B0", "u").join(one("B3", "v"), ["dataset", "tag"]).select("dataset", (F.col("u") - F.col("v")).alias("diff"))
    s = F.stddev_pop("diff")
    return diff.groupBy("dataset").agg(rounded(F.when(s < 1e-10, 0.0).otherwise(F.avg("diff") / s)).alias("d"))


def two_regressors(y: str, a: str, b: str) -> tuple[Column, Column, Column]:
    """Standardised coefficients and R2 from three correlations."""
    ya, yb, ab = correlation(y, a), correlation(y, b), correlation(a, b)
    b1, b2 = (ya - yb * ab) / (1 - ab * ab), (yb - ya * ab) / (1 - ab * ab)
    return b1, b2, b1 * ya + b2 * yb


@query("n18_two_regressors", with_rec("SELECT round((ya - yb * ab) / (1 - ab * ab), 5) AS beta_drift, round((yb - ya * ab) / (1 - ab * ab), 5) AS beta_knn5, round((ya * ya + yb * yb - 2 * ya * yb * ab) / (1 - ab * ab), 5) AS r2 FROM (SELECT corr(acc_drop, drift) AS ya, corr(acc_drop, knn5) AS yb, corr(drift, knn5) AS ab FROM rec)"))
def two_regressor_fit(spark: SparkSession, d: str) -> DataFrame:
    b1, b2, r2 = two_regressors("acc_drop", "drift", "knn5")
    return records(spark, d).agg(rounded(b1, 5).alias("beta_drift"), rounded(b2, 5).alias("beta_knn5"), rounded(r2, 5).alias("r2"))


@query("n19_cross_space", with_rec("SELECT a.backbone AS drift_space, b.backbone AS drop_space, count(*) AS n, round(corr(a.drift, b.acc_drop), 6) AS r FROM rec a JOIN rec b ON a.dataset = b.dataset AND a.tag = b.tag GROUP BY ALL"))
def cross_space(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    a = r.select("dataset", "tag", F.col("backbone").alias("drift_space"), "drift")
    b = r.select("dataset", "tag", F.col("backbone").alias("drop_space"), "acc_drop")
    return a.join(b, ["dataset", "tag"]).groupBy("drift_space", "drop_space").agg(F.count("*").alias("n"), rounded(correlation("drift", "acc_drop")).alias("r"))


@query("n20_asymmetry", with_rec("SELECT a.backbone, a.tag, a.dataset || '<->' || b.dataset AS pair, round(a.acc_drop - b.acc_drop, 6) AS signed, CASE WHEN a.acc_drop > b.acc_drop THEN a.dataset WHEN a.acc_drop < b.acc_drop THEN b.dataset ELSE 'none' END AS harder FROM rec a JOIN rec b ON a.backbone = b.backbone AND a.tag = b.tag AND a.dataset < b.dataset"))
def asymmetry(spark: SparkSession, d: str) -> DataFrame:
    a = records(spark, d).select("backbone", "tag", F.col("dataset").alias("x"), F.col("acc_drop").alias("u"))
    b = records(spark, d).select("backbone", "tag", F.col("dataset").alias("y"), F.col("acc_drop").alias("v"))
    u, v = F.col("u"), F.col("v")
    harder = F.when(u > v, F.col("x")).when(u < v, F.col("y")).otherwise("none")
    return a.join(b, ["backbone", "tag"]).filter("x < y").select("backbone", "tag", F.concat_ws("<->", "x", "y").alias("pair"), rounded(u - v).alias("signed"), harder.alias("harder"))


@query("n21_transfer_summary", with_rec("SELECT tag, count(*) AS cells, round(avg(acc_drop), 6) AS mean, round(stddev_samp(acc_drop), 6) AS std, max(acc_drop) AS worst, round(avg(CASE WHEN dataset = 'D0' THEN acc_drop END) - avg(CASE WHEN dataset = 'D1' THEN acc_drop END), 6) AS gap FROM rec GROUP BY tag"))
def transfer_summary(spark: SparkSession, d: str) -> DataFrame:
    of = lambda v: F.avg(F.when(F.col("dataset") == v, F.col("acc_drop")))
    return records(spark, d).groupBy("tag").agg(F.count("*").alias("cells"), avg6("acc_drop").alias("mean"), rounded(F.stddev_samp("acc_drop")).alias("std"), F.max("acc_drop").alias("worst"), rounded(of("D0") - of("D1")).alias("gap"))


@query("n22_tier_agreement", with_rec("SELECT round(corr(ra, rb), 6) AS rank_agreement FROM (SELECT row_number() OVER (ORDER BY a DESC, backbone, tag) AS ra, row_number() OVER (ORDER BY b DESC, backbone, tag) AS rb FROM (SELECT backbone, tag, avg(CASE WHEN dataset <> 'D2' THEN acc_drop END) AS a, avg(CASE WHEN dataset = 'D2' THEN acc_drop END) AS b FROM rec GROUP BY ALL))"))
def tier_agreement(spark: SparkSession, d: str) -> DataFrame:
    of = lambda c: F.avg(F.when(c, F.col("acc_drop")))
    m = records(spark, d).groupBy("backbone", "tag").agg(of(F.col("dataset") != "D2").alias("a"), of(F.col("dataset") == "D2").alias("b"))
    rank = lambda c: F.row_number().over(Window.orderBy(F.col(c).desc(), "backbone", "tag"))  # noqa: E731  one row for each condition and space
    return m.withColumns({"ra": rank("a"), "rb": rank("b")}).agg(rounded(correlation("ra", "rb")).alias("rank_agreement"))


@query("n23_multilevel_table", with_rec("SELECT backbone, metric, round(corr(value, acc_drop), 6) AS r FROM (SELECT backbone, acc_drop, metric, value FROM rec UNPIVOT (value FOR metric IN (drift, knn1, knn5, centroid))) GROUP BY ALL"))
def multilevel_table(spark: SparkSession, d: str) -> DataFrame:
    long = records(spark, d).unpivot(["backbone", "acc_drop"], ["drift", "knn1", "knn5", "centroid"], "metric", "value")
    return long.groupBy("backbone", "metric").agg(rounded(correlation("value", "acc_drop")).alias("r"))


@query("n24_tier_comparison", with_rec("SELECT 'A' AS tier, count(*) AS n, round(corr(drift, acc_drop), 6) AS r FROM rec WHERE dataset <> 'D2' UNION ALL SELECT 'B', count(*), round(corr(drift, acc_drop), 6) FROM rec WHERE dataset = 'D2'"))
def tier_comparison(spark: SparkSession, d: str) -> DataFrame:
    tier = F.when(F.col("dataset") == "D2", "B").otherwise("A").alias("tier")
    return records(spark, d).groupBy(tier).agg(F.count("*").alias("n"), rounded(correlation("drift", "acc_drop")).alias("r"))
