"""Shift detectors of a batch against a reference bank."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a side of a kernel comparison.
CAP = 512


def capped(rows: DataFrame, keys: Sequence[str], cap: int, seed: str) -> DataFrame:
    """At most ``cap`` rows of each key, those with the smallest hash of seed and id (an explicit sampling operator)."""
    order = Window.partitionBy(*keys).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("vec_id").cast("string"))), "vec_id")
    return rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= cap).drop("_rank")


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def median_gamma(z: np.ndarray) -> float:
    """1 / (2 * median of the squared distances above 1e-12)."""
    far = squared(z, z)[np.triu_indices(len(z), 1)]
    far = far[far > 1e-12]
    return 1 / max(2 * (float(np.median(far)) if len(far) else 1.0), 1e-12)


def kernel_terms(x: np.ndarray, y: np.ndarray, gamma: float) -> tuple[float, float, float]:
    """Means of the RBF kernel within x, within y (diagonals included) and across."""
    return tuple(float(np.exp(-gamma * squared(a, b)).mean()) for a, b in ((x, x), (y, y), (x, y)))


def mmd_terms(batches: DataFrame, keys: Sequence[str], pool_cap: int = CAP, policies: Sequence[tuple[str, float, bool]] = (("pair", 1.0, False),)) -> DataFrame:
    """keys, policy, gamma, k_aa, k_bb, k_ab, mmd2 of capped batches; rows have side (0 reference, 1 target), vec_id and u.

    A key's rows are bounded by the caps of both sides, so one task holds them. ``policies`` (name, factor, shared) scale the
    pair's own gamma or, if shared, the rows' column shared_gamma.
    """

    def run(t: pa.Table) -> pa.Table:
        side = t["side"].to_numpy()
        u = np.array(t["u"].to_pylist())
        order = np.lexsort((t["vec_id"].to_numpy(), side))
        side, u = side[order], u[order]
        pool = u if len(u) <= pool_cap else u[:: -(-len(u) // pool_cap)]
        own = median_gamma(pool)
        out = []
        for name, factor, shared in policies:
            gamma = (t["shared_gamma"][0].as_py() if shared else own) * factor
            aa, bb, ab = kernel_terms(u[side == 0], u[side == 1], gamma)
            out.append((name, gamma, aa, bb, ab, max(aa + bb - 2 * ab, 0.0)))
        cols = list(zip(*out, strict=True))
        return pa.table({**{k: pa.array([t[k][0].as_py()] * len(out), pa.string()) for k in keys}, "policy": pa.array(cols[0]), **{n: pa.array(c) for n, c in zip(("gamma", "k_aa", "k_bb", "k_ab", "mmd2"), cols[1:], strict=True)}})

    schema = ", ".join(f"{k} string" for k in keys) + ", policy string, gamma double, k_aa double, k_bb double, k_ab double, mmd2 double"
    more = ["shared_gamma"] if any(shared for _, _, shared in policies) else []
    return batches.select(*keys, "side", "vec_id", "u", *more).groupBy(*keys).applyInArrow(run, schema)


def shared_gamma(rows: DataFrame, key: str, source: str, cap: int = CAP) -> DataFrame:
    """key, shared_gamma: one bandwidth of each key, from a capped pool that takes alike from every source."""
    sources = rows.select(source).distinct().agg(F.greatest(F.lit(32), F.floor(F.lit(float(cap)) / F.count(F.lit(1)))).alias("_each"))
    order = Window.partitionBy(key, source).orderBy(F.md5(F.concat(F.lit("shared|"), F.col("vec_id").cast("string"))), "vec_id")
    some = rows.withColumn("_rank", F.row_number().over(order)).crossJoin(F.broadcast(sources)).filter("_rank <= _each")  # one row
    pool = capped(some, [key], cap, "shared pool")

    def run(t: pa.Table) -> pa.Table:
        u = pc.list_flatten(t["u"]).to_numpy().reshape(t.num_rows, -1)
        return pa.table({key: pa.array([t[key][0].as_py()], pa.string()), "shared_gamma": [median_gamma(u)]})

    return pool.select(key, "u").groupBy(key).applyInArrow(run, f"{key} string, shared_gamma double")


def moments(rows: DataFrame, keys: Sequence[str], dim: int) -> DataFrame:
    """keys, n, s (sum), g (sum of outer products, flat), q (sum of fourth powers of norms): partial sums by Arrow batch, then added up."""

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = batch.column(len(keys)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            names = list(zip(*(batch.column(i).to_pylist() for i in range(len(keys))), strict=True))
            for name in sorted(set(names)):
                x = u[[n == name for n in names]]
                sq = (x * x).sum(1)
                flat = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel(), [(sq * sq).sum()]])
                yield pa.RecordBatch.from_pydict({**{k: [v] for k, v in zip(keys, name, strict=True)}, "flat": pa.array([flat.tolist()], pa.list_(pa.float64()))})

    size = 2 + dim + dim * dim
    sums = rows.select(*keys, "u").mapInArrow(part, ", ".join(f"{k} string" for k in keys) + ", flat array<double>")
    added = sums.select(*keys, F.posexplode("flat")).groupBy(*keys, "pos").agg(F.sum("col").alias("v"))
    flat = added.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("f"))  # size fixed by dim
    return flat.select(*keys, F.col("f")[0].alias("n"), F.slice("f", 2, dim).alias("s"), F.slice("f", 2 + dim, dim * dim).alias("g"), F.col("f")[size - 1].alias("q"))


def ledoit_wolf(n: float, s: np.ndarray, g: np.ndarray, q: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, shrunk covariance and shrinkage from moments about 0, by the published formula on centred data.

    ``q`` is the sum of fourth powers of centred norms.
    """
    p = len(s)
    mean = s / n
    cov = g / n - np.outer(mean, mean)
    mu = np.trace(cov) / p
    delta = ((cov - mu * np.eye(p)) ** 2).sum() / p
    beta = min((q / n - (cov**2).sum()) / n / p, delta)
    shrink = 0.0 if delta == 0 else max(beta / delta, 0.0)
    return mean, (1 - shrink) * cov + shrink * mu * np.eye(p), shrink
