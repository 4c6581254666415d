"""Scores of a shift monitor over batch sizes, reference sizes and repeats.

Rows of a condition and of its reference bank are put in the order of a hash of seed, repeat and id; a batch of n is the first n of the
condition, a reference of m the first m of the bank. So all cells of a repeat are leading blocks of the same matrices: similarities and
squared distances are computed once, and a cell looks up

* neighbour distances among the first m columns, averaged over the first n rows;
* prefix sums of the vectors for both centroids, and of hits for the batch's accuracy;
* two-way prefix sums of the kernel matrices for the discrepancy at a shared bandwidth, the median of the largest cell;
* for the discrepancy at the cell's own bandwidth, all distances of the cell; those within a reference are taken out once for all conditions of a repeat.

Only the rows that the largest cell needs leave the bank: at most max(batch) a condition and repeat, max(reference) a bank and repeat. A task holds
one bank's reference and the batches of its conditions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.operators.detectors import squared

#: Fixed values.
BATCHES, REFERENCES, REPEATS = (8, 16, 32, 64), (100, 250, 500, 1000), 5
SCORES = ("ref_knn1_dist", "ref_knn5_dist", "ref_centroid_cosine", "ref_mmd_rbf", "ref_mmd_shared")


def first_by_hash(rows: DataFrame, keys: Sequence[str], most: int, repeats: int, seed: str, salt: Sequence[str] = ()) -> DataFrame:
    """Rows with repeat and place (from 0): of each key and repeat the ``most`` rows of least hash of seed, repeat, salt and vec_id."""
    rows = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    parts = [F.lit(seed), F.col("repeat").cast("string"), *[F.col(c) for c in salt], F.col("vec_id").cast("string")]
    order = Window.partitionBy(*keys, "repeat").orderBy(F.md5(F.concat_ws("|", *parts)), "vec_id")
    # filtered by the number itself, so that a task sends no more rows of a key than are asked for
    return rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).withColumn("place", F.col("nth") - 1).drop("nth")


def _gamma(far: np.ndarray) -> float:
    """1 / (2 * median) of the squared distances above 1e-12."""
    far = far[far > 1e-12]
    return 1 / max(2 * (float(np.median(far)) if len(far) else 1.0), 1e-12)


def _triangle(d: np.ndarray) -> np.ndarray:
    return d[np.triu_indices(len(d), 1)]


def _kernel_mean(far: np.ndarray, n: int, gamma: float) -> float:
    """Mean of the kernel of n rows with each other from the distances of their pairs; a row's with itself is 1."""
    return (2 * float(np.exp(-gamma * far).sum()) + n) / n**2


def _discrepancy(xx: float, yy: float, xy: float) -> float:
    return max(xx + yy - 2 * xy, 0.0)


def reference_far(reference: np.ndarray, references: Sequence[int]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Squared distances within a reference, and those of the pairs of its first rows, by their number."""
    yy = squared(reference, reference)
    return yy, {m: _triangle(yy[:m, :m]) for m in {min(m, len(reference)) for m in references}}


def cells(batch: np.ndarray, hits: np.ndarray, reference: np.ndarray, batches: Sequence[int], references: Sequence[int], far: tuple[np.ndarray, dict[int, np.ndarray]] | None = None) -> Iterator[tuple]:
    """(batch_size, reference_size, n_batch, n_ref, acc_batch, scores...) of every cell that has two rows a side; ``far`` is ``reference_far``'s."""
    sim = batch @ reference.T
    yy, far_y = far or reference_far(reference, references)
    xx, xy = squared(batch, batch), np.maximum((batch * batch).sum(1)[:, None] + (reference * reference).sum(1)[None, :] - 2 * sim, 0)
    far_x = {n: _triangle(xx[:n, :n]) for n in {min(n, len(batch)) for n in batches}}
    n_most, m_most = max(far_x), max(far_y)
    shared = _gamma(np.concatenate([far_x[n_most], far_y[m_most], xy[:n_most, :m_most].ravel()]))
    tables = [np.exp(-shared * m).cumsum(0).cumsum(1) for m in (xx, yy, xy)]
    sums, ref_sums, right = batch.cumsum(0), reference.cumsum(0), hits.cumsum()
    for m in references:
        m_used = min(m, len(reference))
        if m_used < 2:
            continue
        k = min(5, m_used)
        near = 1 - -np.sort(np.partition(-sim[:, :m_used], k - 1, axis=1)[:, :k], axis=1)
        first, all_k = near[:, 0].cumsum(), near.sum(1).cumsum()
        for n in batches:
            n_used = min(n, len(batch))
            if n_used < 2:
                continue
            a, b = sums[n_used - 1] / n_used, ref_sums[m_used - 1] / m_used
            centroid = 1 - float(a @ b) / ((np.linalg.norm(a) + 1e-8) * (np.linalg.norm(b) + 1e-8))
            across = xy[:n_used, :m_used].ravel()
            own = _gamma(np.concatenate([far_x[n_used], far_y[m_used], across]))
            mmd = _discrepancy(_kernel_mean(far_x[n_used], n_used, own), _kernel_mean(far_y[m_used], m_used, own), float(np.exp(-own * across).mean()))
            parts = (tables[0][n_used - 1, n_used - 1] / n_used**2, tables[1][m_used - 1, m_used - 1] / m_used**2, tables[2][n_used - 1, m_used - 1] / (n_used * m_used))
            yield n, m, n_used, m_used, float(right[n_used - 1] / n_used), float(first[n_used - 1] / n_used), float(all_k[n_used - 1] / (n_used * k)), centroid, mmd, _discrepancy(*map(float, parts))


def size_grid(shifted: DataFrame, bank: DataFrame, keys: Sequence[str], condition: str = "tag", batches: Sequence[int] = BATCHES, references: Sequence[int] = REFERENCES, repeats: int = REPEATS, seed: str = "grid") -> DataFrame:
    """keys, condition, repeat, batch_size, reference_size, n_batch, n_ref, acc_batch and scores: one row for each cell.

    ``shifted`` has keys, condition, vec_id, u (a unit vector) and hit (is its prediction right, 0 or 1); ``bank`` has keys, vec_id and u. Sizes
    beyond a side's rows use all of them; cells with fewer than two rows a side are left out. Vectors may have any dimension. Rows that no repeat
    draws (``first_by_hash``) may be left out of both.
    """
    left = first_by_hash(shifted.select(*keys, condition, "vec_id", "u", F.col("hit").cast("double").alias("hit")), [*keys, condition], max(batches), repeats, seed, [condition])
    right = first_by_hash(bank.select(*keys, "vec_id", "u"), keys, max(references), repeats, seed)

    def run(some: pa.Table, ref: pa.Table) -> pa.Table:
        out = []
        if some.num_rows and ref.num_rows:
            reference = np.array(ref.sort_by("place")["u"].to_pylist())
            far = reference_far(reference, references)
            some = some.sort_by([(condition, "ascending"), ("place", "ascending")])
            names = some[condition].to_pylist()
            key = [some[k][0].as_py() for k in keys] + [some["repeat"][0].as_py()]
            vectors, hits = np.array(some["u"].to_pylist()), some["hit"].to_numpy()
            cut = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            for a, e in zip(cut, cut[1:], strict=False):
                out += [(*key, names[a], *cell) for cell in cells(vectors[a:e], hits[a:e], reference, batches, references, far)]
        types = [pa.string()] * len(keys) + [pa.int32(), pa.string()] + [pa.int32()] * 4 + [pa.float64()] * 6
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=columns)

    columns = [*keys, "repeat", condition, "batch_size", "reference_size", "n_batch", "n_ref", "acc_batch", *SCORES]
    schema = ", ".join([*[f"{k} string" for k in keys], f"repeat int, {condition} string, batch_size int, reference_size int, n_batch int, n_ref int, acc_batch double", *[f"{s} double" for s in SCORES]])
    return left.groupBy(*keys, "repeat").cogroup(right.groupBy(*keys, "repeat")).applyInArrow(run, schema)
