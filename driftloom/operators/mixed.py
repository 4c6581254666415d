"""Mixed models with crossed random effects: y = X b + Z1 u1 + Z2 u2 + ... + e.

Each grouping's effects are independent with a variance of their own; groupings may cross in any way. Rows are read once, into

* one row for each level of a grouping: count, sums of the fixed columns, sum of y;
* one row for each pair of levels of two groupings that occur together: count;
* the fixed columns' sums of products, a matrix as small as the design.

Henderson's equations for all effects are made of just these. They are solved by conjugate gradients with the diagonal (and the fixed
block's inverse) as preconditioner: a vector is a written table with an entry for each level, a product with the coefficient matrix one
join and one ``groupBy`` over the pairs, and only inner products come to the driver. Several right-hand sides share a pass. Variances follow by
average-information steps on the (restricted) likelihood, whose traces are estimated with fixed random signs of the levels.

Where all levels together are few (``direct``, a documented bound), the same equations are one small matrix, solved at once with exact traces.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.operators.regression import products, unpack
from driftloom.sources.store import written

#: A vector of all effects: the fixed ones, and a table (g, level, v) with ``columns`` numbers for each level.
@dataclass
class Vector:
    fixed: np.ndarray
    table: DataFrame | None = None
    dense: np.ndarray | None = None


@dataclass
class Fit:
    """What ``crossed`` returns. ``effects`` has grouping, level, n, effect: one row for each level."""

    n: int
    method: str
    names: list[str]
    beta: np.ndarray
    se: np.ndarray
    groupings: list[str]
    variances: np.ndarray
    residual: float
    loglike: float | None
    rounds: int
    converged: bool
    effects: DataFrame = field(repr=False)


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


class Equations:
    """Sums over the rows, and Henderson's coefficient matrix for given variances."""

    def __init__(self, rows: DataFrame, y: Column, fixed: Sequence[Column], groupings: Sequence[str], direct: int):
        self.p, self.groupings, self.spark = len(fixed), list(groupings), rows.sparkSession
        names = [f"l{g}" for g in range(len(groupings))]
        base = rows.select(y.cast("double").alias("y"), F.array(*[c.cast("double") for c in fixed]).alias("x"), *[F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(groupings, names, strict=True)])
        whole = F.col("y").isNotNull() & ~F.isnan("y") & ~F.exists("x", lambda v: v.isNull() | F.isnan(v))
        for n in names:
            whole = whole & F.col(n).isNotNull()
        base = base.filter(whole)
        got = products(base, [*[F.col("x")[i] for i in range(self.p)], F.col("y")]).first()
        if got is None:
            raise ValueError("no row has all of y, the fixed columns and the groupings")
        xx = unpack(got["xx"], self.p + 1)
        self.n, self.xx, self.xy, self.yy = int(got["n"]), xx[: self.p, : self.p], xx[: self.p, self.p], float(xx[self.p, self.p])
        self.inverse = np.linalg.pinv(self.xx, hermitian=True, rcond=1e-10)
        self.rank = int(np.linalg.matrix_rank(self.xx, tol=1e-9 * max(np.abs(self.xx).max(), 1), hermitian=True))
        levels, pairs = None, None
        for g, n in enumerate(names):
            sums = base.groupBy(F.lit(g).alias("g"), F.col(n).alias("level")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.array(*[F.sum(F.col("x")[i]) for i in range(self.p)]).alias("sx"), F.sum("y").alias("sy"))
            levels = sums if levels is None else levels.unionByName(sums)
            for h in range(g):
                both = base.groupBy(F.col(names[h]).alias("a"), F.col(n).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
                for i, j, a, b in ((h, g, "a", "b"), (g, h, "b", "a")):
                    one = both.select(F.lit(i).alias("g"), F.col(a).alias("level"), F.lit(j).alias("og"), F.col(b).alias("other"), "n")
                    pairs = one if pairs is None else pairs.unionByName(one)
        self.levels = written(levels)
        self.pairs = written(pairs) if pairs is not None else None
        counts = {r["g"]: r["k"] for r in self.levels.groupBy("g").agg(F.count(F.lit(1)).alias("k")).collect()}  # one row for each grouping
        self.q = np.array([counts[g] for g in range(len(names))], float)
        self.small = self.q.sum() <= direct
        if self.small:
            self._small()

    def _small(self) -> None:
        """All sums as one matrix: at most ``direct`` levels."""
        rows = self.levels.orderBy("g", "level").collect()
        at = {(r["g"], r["level"]): i for i, r in enumerate(rows)}
        self.order, self.group = list(at), np.array([r["g"] for r in rows])
        self.zz = np.diag([r["n"] for r in rows])
        for r in self.pairs.collect() if self.pairs is not None else []:
            self.zz[at[r["g"], r["level"]], at[r["og"], r["other"]]] = r["n"]
        self.xz = np.array([r["sx"] for r in rows]).T
        self.zy = np.array([r["sy"] for r in rows])

    # -- vectors --

    def right_side(self) -> Vector:
        if self.small:
            return Vector(self.xy[:, None], dense=self.zy[:, None])
        return Vector(self.xy[:, None], self.levels.select("g", "level", F.array("sy").alias("v")))

    def signs(self, probes: int) -> Vector:
        """Random signs of every level, by hash: the same in every run."""
        sign = [F.when(F.xxhash64(F.lit(s), "g", "level") % 2 == 0, 1.0).otherwise(-1.0) for s in range(probes)]
        return Vector(np.zeros((self.p, probes)), self.levels.select("g", "level", F.array(*sign).alias("v")))

    def unit(self) -> Vector:
        """A column for each fixed effect."""
        if self.small:
            return Vector(np.eye(self.p), dense=np.zeros((len(self.group), self.p)))
        return Vector(np.eye(self.p), self.levels.select("g", "level", F.array_repeat(F.lit(0.0), self.p).alias("v")))

    def only(self, v: Vector, weights: Sequence[float]) -> Vector:
        """A column for each grouping: the effects of that one times its weight, all others 0."""
        if self.small:
            return Vector(np.zeros((self.p, len(weights))), dense=np.stack([np.where(self.group == g, v.dense[:, 0] * w, 0.0) for g, w in enumerate(weights)], axis=1))
        cols = [F.when(F.col("g") == g, F.col("v")[0] * F.lit(float(w))).otherwise(0.0) for g, w in enumerate(weights)]
        return Vector(np.zeros((self.p, len(weights))), v.table.select("g", "level", F.array(*cols).alias("v")))

    def total(self, v: Vector) -> Vector:
        """The sum of the levels' columns, without fixed part."""
        if self.small:
            return Vector(np.zeros((self.p, 1)), dense=v.dense.sum(1, keepdims=True))
        return Vector(np.zeros((self.p, 1)), v.table.select("g", "level", F.array(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)).alias("v")))

    def beside(self, *some: Vector) -> Vector:
        """The columns of several vectors in one."""
        fixed = np.concatenate([v.fixed for v in some], axis=1)
        if self.small:
            return Vector(fixed, dense=np.concatenate([v.dense for v in some], axis=1))
        out = some[0].table
        for v in some[1:]:
            out = out.join(v.table.withColumnRenamed("v", "w"), ["g", "level"]).select("g", "level", F.concat("v", "w").alias("v"))
        return Vector(fixed, out)

    def columns(self, v: Vector, lo: int, hi: int) -> Vector:
        if self.small:
            return Vector(v.fixed[:, lo:hi], dense=v.dense[:, lo:hi])
        return Vector(v.fixed[:, lo:hi], v.table.select("g", "level", F.slice("v", lo + 1, hi - lo).alias("v")))

    def inner(self, a: Vector, b: Vector) -> np.ndarray:
        """(grouping, column): inner products of the levels' parts."""
        k, out = a.fixed.shape[1], None
        if self.small:
            return np.stack([(a.dense[self.group == g] * b.dense[self.group == g]).sum(0) for g in range(len(self.q))])
        both = a.table.join(b.table.withColumnRenamed("v", "w"), ["g", "level"])
        out = np.zeros((len(self.q), k))
        for r in both.groupBy("g").agg(F.array(*[F.sum(F.col("v")[i] * F.col("w")[i]) for i in range(k)]).alias("s")).collect():  # one row for each grouping
            out[r["g"]] = r["s"]
        return out

    def gram(self, a: Vector, b: Vector) -> np.ndarray:
        """Inner products of all columns of a with all of b, over all levels."""
        if self.small:
            return a.dense.T @ b.dense
        k, m = a.fixed.shape[1], b.fixed.shape[1]
        both = a.table.join(b.table.withColumnRenamed("v", "w"), ["g", "level"])
        return self._flat(both, [F.sum(F.col("v")[i] * F.col("w")[j]) for i in range(k) for j in range(m)]).reshape(k, m)

    def times(self, v: Vector) -> Vector:
        """W'W v, the sums of products over all rows times v."""
        if self.small:
            return Vector(self.xx @ v.fixed + self.xz @ v.dense, dense=self.xz.T @ v.fixed + self.zz @ v.dense)
        k = v.fixed.shape[1]
        made = self._product(v.fixed, self.levels.join(v.table, ["g", "level"]), k, ("v",))
        return Vector(self.xx @ v.fixed + self._flat(made, self._shares(k)).reshape(self.p, k), made.select("g", "level", F.col("av").alias("v")))

    def _product(self, fixed: np.ndarray, state: DataFrame, k: int, keep: Sequence[str]) -> DataFrame:
        """``state`` (g, level, n, sx, v, ...) with av, the levels' part of W'W v: one join to the pairs, one aggregate; written."""
        mine = F.transform("v", lambda x: x * F.col("n"))
        if fixed.any():
            # one row of numbers, so that every step compiles to the same code
            numbers = self.spark.createDataFrame([(fixed.T.tolist(),)], "f array<array<double>>")
            state = state.crossJoin(F.broadcast(numbers))
            part = F.transform("f", lambda c: F.aggregate(F.zip_with("sx", c, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x))
            mine = _plus(mine, part)
        own = state.select("g", "level", mine.alias("av"), F.struct("n", "sx", *keep).alias("own"))
        if self.pairs is not None:
            there = state.select(F.col("g").alias("og"), F.col("level").alias("other"), F.col("v").alias("w"))
            cross = self.pairs.join(there, ["og", "other"]).select("g", "level", F.transform("w", lambda x: x * F.col("n")).alias("av"), F.lit(None).cast(own.schema["own"].dataType).alias("own"))
            own = own.unionByName(cross).groupBy("g", "level").agg(F.array(*[F.sum(F.col("av")[c]) for c in range(k)]).alias("av"), F.first("own", ignorenulls=True).alias("own"))
        return written(own.select("g", "level", "own.*", "av"))

    def _shares(self, k: int) -> list[Column]:
        """Sums over the levels for the fixed part of W'W v."""
        return [F.sum(F.col("sx")[i] * F.col("v")[c]) for i in range(self.p) for c in range(k)]

    @staticmethod
    def _flat(rows: DataFrame, sums: list[Column]) -> np.ndarray:
        return np.array(rows.agg(F.array(*sums).alias("s")).first()["s"], float)

    # -- the equations for given variances --

    def solve(self, b: Vector, ratios: np.ndarray, with_fixed: np.ndarray, start: Vector | None = None, tolerance: float = 1e-8, most: int = 200) -> Vector:
        """(W'W + ratio I) s = b for every column; columns without ``with_fixed`` leave the fixed effects out."""
        if self.small:
            return self._solve_small(b, ratios, with_fixed)
        k = b.fixed.shape[1]
        on = with_fixed.astype(float)
        diagonal = F.col("n") + F.col("ratio")
        ratio = self.spark.createDataFrame([(g, float(x)) for g, x in enumerate(ratios)], "g int, ratio double")
        levels = self.levels.drop("sy").join(F.broadcast(ratio), "g")  # a row for each grouping
        state = levels.join(b.table.withColumnRenamed("v", "r"), ["g", "level"])
        xf, rf = np.zeros((self.p, k)), b.fixed * on
        size = self._flat(state, [F.sum(F.col("r")[c] * F.col("r")[c] / diagonal) for c in range(k)]) + (rf * (self.inverse @ rf)).sum(0)
        state = state.withColumn("x", F.array_repeat(F.lit(0.0), k))
        if start is not None:
            made = self._product(start.fixed, state.drop("x").join(start.table, ["g", "level"]), k, ("ratio", "r", "v"))
            rf = (b.fixed - self.xx @ start.fixed - self._flat(made, self._shares(k)).reshape(self.p, k)) * on
            xf = start.fixed.copy()
            state = made.select("g", "level", "n", "sx", "ratio", F.expr("transform(r, (x, i) -> x - av[i] - ratio * v[i])").alias("r"), F.col("v").alias("x"))
        state = state.withColumn("v", F.transform("r", lambda x: x / diagonal))
        pf = self.inverse @ rf
        for _ in range(most):
            state = self._product(pf, state, k, ("ratio", "x", "r", "v")).withColumn("av", F.expr("transform(av, (x, i) -> x + ratio * v[i])"))
            r, a, v = ([F.col(name)[c] for c in range(k)] for name in ("r", "av", "v"))
            sums = [F.sum(x) for c in range(k) for x in (v[c] * a[c], r[c] * r[c] / diagonal, r[c] * a[c] / diagonal, a[c] * a[c] / diagonal)]
            got = self._flat(state, sums + self._shares(k))
            va, rr, ra, aa = got[: 4 * k].reshape(k, 4).T
            af = (self.xx @ pf + got[4 * k :].reshape(self.p, k)) * on
            va = va + (pf * af).sum(0)
            rz = rr + (rf * (self.inverse @ rf)).sum(0)
            go = rz > tolerance**2 * np.maximum(size, 1e-300)
            if not go.any():
                break
            alpha = np.where(go & (va > 0), rz / np.where(va > 0, va, 1), 0.0)
            fine = rr - 2 * alpha * ra + alpha**2 * aa
            xf, rf = xf + alpha * pf, rf - alpha * af
            beta = np.where(go, np.maximum(fine + (rf * (self.inverse @ rf)).sum(0), 0) / np.maximum(rz, 1e-300), 0.0)
            pf = self.inverse @ rf + beta * pf
            step = self.spark.createDataFrame([(alpha.tolist(), beta.tolist())], "alpha array<double>, beta array<double>")
            state = state.crossJoin(F.broadcast(step)).select(  # one row of numbers
                "g", "level", "n", "sx", "ratio", "beta", "v", F.expr("transform(x, (y, i) -> y + alpha[i] * v[i])").alias("x"), F.expr("transform(r, (y, i) -> y - alpha[i] * av[i])").alias("r")
            )
            state = state.withColumn("v", F.expr("transform(r, (y, i) -> y / (n + ratio) + beta[i] * v[i])")).drop("beta")
        return Vector(xf, state.select("g", "level", F.col("x").alias("v")))

    def _matrix(self, ratios: np.ndarray) -> np.ndarray:
        return np.block([[self.xx, self.xz], [self.xz.T, self.zz + np.diag(ratios[self.group])]])

    def _solve_small(self, b: Vector, ratios: np.ndarray, with_fixed: np.ndarray) -> Vector:
        whole = np.linalg.pinv(self._matrix(ratios), hermitian=True, rcond=1e-12) @ np.concatenate([b.fixed, b.dense])
        if with_fixed.all():
            return Vector(whole[: self.p], dense=whole[self.p :])
        alone = np.linalg.solve(self.zz + np.diag(ratios[self.group]), b.dense)
        return Vector(np.where(with_fixed, whole[: self.p], 0.0), dense=np.where(with_fixed, whole[self.p :], alone))

    def exact_traces(self, ratios: np.ndarray, fixed: bool) -> np.ndarray:
        a = np.linalg.pinv(self._matrix(ratios), hermitian=True, rcond=1e-12)[self.p :, self.p :] if fixed else np.linalg.inv(self.zz + np.diag(ratios[self.group]))
        return np.array([np.diag(a)[self.group == g].sum() for g in range(len(self.q))])

    def likelihood(self, variances: np.ndarray, residual: float, quadratic: float, restricted: bool) -> float | None:
        """The log-likelihood, where the determinant is at hand: for few levels."""
        if not self.small:
            return None
        a = self.zz / residual + np.diag(1 / variances[self.group])
        log = self.n * math.log(residual) + (self.q * np.log(variances)).sum() + np.linalg.slogdet(a)[1]
        free = self.n
        if restricted:
            info = self.xx / residual - self.xz @ np.linalg.solve(a, self.xz.T) / residual**2
            values = np.linalg.eigvalsh(info)[::-1][: self.rank]
            log, free = log + np.log(values).sum(), self.n - self.rank
        return -0.5 * (log + quadratic / residual + free * math.log(2 * math.pi))


def crossed(rows: DataFrame, y: str | Column, fixed: dict[str, Column], groupings: Sequence[str], method: str = "ml", direct: int = 512, probes: int = 8, rounds: int = 60, tolerance: float = 1e-7, precision: float = 1e-5) -> Fit:
    """Fit y on the ``fixed`` columns (one should be constant) with a random effect for each level of each grouping.

    ``method`` is ml or reml. ``probes`` random signs estimate traces and ``precision`` ends a solution by iteration, where levels are more than ``direct``. Rows with a null (or NaN) in y, a fixed column or a grouping are left out. A variance that wants to be negative
    stays at a billionth of the residual one.
    """
    restricted = method == "reml"
    eq = Equations(rows, F.col(y) if isinstance(y, str) else y, list(fixed.values()), groupings, direct)
    k, q, free = len(groupings), eq.q, eq.n - (eq.rank if restricted else 0)
    rss = max(eq.yy - eq.xy @ eq.inverse @ eq.xy, 1e-12 * max(eq.yy, 1e-300))
    s2, var = rss / eq.n / 2, np.full(k, rss / eq.n / 2 / k)
    b, signs = eq.right_side(), None if eq.small else eq.signs(probes)
    theta = solved = None
    turn, converged = 0, False
    for turn in range(1, rounds + 1):
        ratios = s2 / var
        if eq.small:
            theta = eq.solve(b, ratios, np.array([True]))
            traces = eq.exact_traces(ratios, restricted) * s2
            tb, uu = eq.inner(theta, b)[:, 0], eq.inner(theta, theta)[:, 0]
        else:
            on = np.array([True] + [restricted] * probes)
            solved = eq.solve(eq.beside(b, signs), ratios, on, solved, precision)
            theta = eq.columns(solved, 0, 1)
            got = eq.inner(eq.beside(solved, theta), eq.beside(b, signs, theta))
            tb, traces, uu = got[:, 0], got[:, 1 : probes + 1].mean(1) * s2, got[:, probes + 1]
        explained = float(theta.fixed[:, 0] @ eq.xy + tb.sum())
        ee = max(eq.yy - explained - float((ratios * uu).sum()), 1e-12 * eq.yy)
        score = np.append(-0.5 * (q / var - (traces + uu) / var**2), -0.5 * (free / s2 - (q - traces / var).sum() / s2 - ee / s2**2))
        # average information: inner products of the working variates Z u / var and e / s2, less what the model explains of them
        pieces = eq.only(theta, 1 / var)
        rights = eq.times(pieces)
        work = eq.beside(rights, eq.total(pieces))
        done = eq.solve(work, ratios, np.full(k + 1, True), None, precision)  # from 0: errors of inner products with the right side are then of second order
        cross = np.zeros((k + 1, k + 1))  # f_i' f_j
        cross[:k, :k] = eq.gram(pieces, rights)
        cross[:k, k] = cross[k, :k] = uu / var**2
        cross[k, k] = ee / s2**2
        info = 0.5 * (cross - work.fixed.T @ done.fixed - eq.gram(work, done)) / s2
        info = (info + info.T) / 2
        now = np.append(var, s2)
        floor = 1e-9 * s2
        flat = np.append(np.diag(info)[:k] < 1e-3 * (q - traces / var) / var**2, False)  # effects near 0 say nothing about their curvature
        step = np.sign(score) * now
        step[~flat] = np.linalg.lstsq(info[np.ix_(~flat, ~flat)], score[~flat], rcond=None)[0]
        step[(now <= 1.001 * floor) & (step < 0)] = 0.0
        em = np.append((uu + traces) / q, ee / max(free - (q - traces / var).sum(), 1e-9))  # always positive and uphill
        new = np.maximum(now + step, now / 10) if turn > 2 else em
        new = np.maximum(new, floor)
        moved = np.abs(new - now).max() / now.max()
        var, s2 = new[:k], float(new[k])
        if moved < tolerance:
            converged = True
            break
    ratios = s2 / var
    theta = eq.solve(b, ratios, np.array([True]), theta if not eq.small else None)
    spread = eq.solve(eq.unit(), ratios, np.full(eq.p, True))
    se = np.sqrt(np.maximum(np.diag(spread.fixed) * s2, 0))
    quadratic = eq.yy - float(theta.fixed[:, 0] @ eq.xy + eq.inner(theta, b)[:, 0].sum())
    effects = theta.table
    if eq.small:
        effects = eq.spark.createDataFrame([(g, level, [float(v)]) for (g, level), v in zip(eq.order, theta.dense[:, 0], strict=True)], "g int, level string, v array<double>")
    effects = effects.join(eq.levels.select("g", "level", "n"), ["g", "level"])
    effects = effects.select(F.element_at(F.array(*[F.lit(c) for c in groupings]), F.col("g") + 1).alias("grouping"), "level", F.col("n").cast("long").alias("n"), F.col("v")[0].alias("effect"))
    return Fit(eq.n, method, list(fixed), theta.fixed[:, 0], se, list(groupings), var, s2, eq.likelihood(var, s2, quadratic, restricted), turn, converged, effects)
