"""Linear heads on frozen vectors: ridge and multinomial logistic regression of many groups at once.

Rows are (grp, label, u); each group (a space, a split, a training set) has a head of its own. Features are standardised within the group.
A row may belong to many groups (an array of names): it is held and read once, in blocks of rows of the same groups.

* ``ridge``: +-1 targets and normal equations, from one aggregate of each group's moments.
* ``logistic``: quasi-Newton steps on the penalised likelihood. A step is one aggregate for all groups and classes: each task adds up losses and
  gradients of its rows, groups add up tasks. The first curvature is the upper bound 1/2 (I - 1/C) x X'X, so a full step nearly always
  goes down; groups for which it doesn't go half as far in the next pass, and groups that are done take no more part.

Heads are (classes, weights) of each group on the driver: groups x classes x dimensions numbers, and for ``logistic`` groups x dimensions^2, both
bounded by ``MOST`` (an error beyond it, never a cut). Rows never leave the executors.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.sources.store import written

#: Numbers that heads may have on the driver.
MOST = 50_000_000
HISTORY = 10


@dataclass
class Head:
    """Scores of a vector x are ``weights[:, 0] + weights[:, 1:] @ x``, one for each of ``classes``."""

    classes: np.ndarray
    weights: np.ndarray
    loss: float = 0.0
    passes: int = 0
    converged: bool = True


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _packed(rows: DataFrame) -> DataFrame:
    """Rows (grps, label, u) as blocks of rows of the same groups: grps (JSON), labels, vectors, least and most dimensions."""
    spark = rows.sparkSession
    rows = rows.select(F.to_json("grps").alias("grps"), "label", "u", F.spark_partition_id().alias("salt"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode()
            code = codes.indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            out = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                u = batch.column(2).slice(lo, hi - lo)
                sizes = u.value_lengths().to_numpy()
                flat = u.flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes()
                out.append((codes.dictionary[int(code[lo])].as_py(), batch.column(1).slice(lo, hi - lo).to_numpy().astype("<i8").tobytes(), flat, int(sizes.min()), int(sizes.max())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.int32()), strict=True)], ["grps", "labels", "vectors", "e", "d"])

    # the salt spreads the rows of one list of groups over tasks
    dealt = rows.repartition(parts, "grps", "salt").drop("salt").sortWithinPartitions("grps")
    return dealt.mapInArrow(pack, "grps string, labels binary, vectors binary, e int, d int")


def _by_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(groups, labels, vectors with a constant first) of every block."""
    for batch in batches:
        for names, labels, vectors in zip(batch.column("grps").to_pylist(), batch.column("labels"), batch.column("vectors"), strict=True):
            y = np.frombuffer(labels.as_buffer(), "<i8")
            x = np.frombuffer(vectors.as_buffer(), "<f8").reshape(len(y), -1)
            yield json.loads(names), y, np.concatenate([np.ones((len(x), 1)), x], axis=1)


def _summed(packed: DataFrame, part) -> dict[str, np.ndarray]:
    """``part`` gives (group, numbers) for some rows; their sums by group: within a task, then over tasks."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for name, numbers in part(_by_groups(batches)):
            sums[name] = sums[name] + numbers if name in sums else numbers
        if sums:
            yield pa.RecordBatch.from_pydict({"grp": list(sums), "flat": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(x.as_py()) for x in t["flat"][1:]), np.frombuffer(t["flat"][0].as_py()).copy())
        return pa.table({"grp": pa.array([t["grp"][0].as_py()]), "flat": pa.array([total.tobytes()], pa.binary())})

    schema = "grp string, flat binary"
    parts = packed.select("grps", "labels", "vectors").mapInArrow(task, schema)
    return {r["grp"]: np.frombuffer(r["flat"]) for r in parts.groupBy("grp").applyInArrow(add, schema).collect()}  # one row for each group


def _prepared(rows: DataFrame) -> tuple[DataFrame, dict[str, np.ndarray], int]:
    """Rows without nulls in written blocks, each group's classes, the dimension."""
    many = rows.schema["grp"].dataType.typeName() == "array"
    grps = F.array_compact(F.col("grp").cast("array<string>")) if many else F.array(F.col("grp").cast("string"))
    rows = rows.filter("grp IS NOT NULL AND label IS NOT NULL AND u IS NOT NULL").select(grps.alias("grps"), F.col("label").cast("long").alias("label"), F.col("u").cast("array<double>").alias("u")).filter(F.size("grps") > 0)
    packed = written(_packed(rows))

    def known(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, set[int]] = {}
        for batch in batches:
            for names, labels in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for name in json.loads(names):
                    seen.setdefault(name, set()).update(np.unique(np.frombuffer(labels.as_buffer(), "<i8")).tolist())
        yield pa.RecordBatch.from_pydict({"grp": pa.array(list(seen), pa.string()), "classes": pa.array([sorted(c) for c in seen.values()], pa.list_(pa.int64()))})

    found = packed.select("grps", "labels").mapInArrow(known, "grp string, classes array<long>").groupBy("grp").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("classes")))).alias("classes")).collect()  # classes of each group
    sizes = packed.agg(F.min("e").alias("e"), F.max("d").alias("d")).first()
    if sizes["e"] != sizes["d"]:
        raise ValueError("vectors have different dimensions")
    d = sizes["d"] or 0
    classes = {r["grp"]: np.array(r["classes"]) for r in found}
    if sum(len(c) for c in classes.values()) * (d + 1) > MOST or len(classes) * (d + 1) ** 2 > MOST:
        raise ValueError(f"more than {MOST} numbers of heads")
    return packed, classes, d


def _moments(rows: DataFrame, classes: dict[str, np.ndarray], d: int) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each group: X'X with a constant first, rows and sums of each class."""

    def part(groups):
        for names, labels, z in groups:
            zz = (z.T @ z).ravel()
            for name in names:
                y = (labels[:, None] == classes[name][None, :]).astype(float)
                yield name, np.concatenate([zz, (y.T @ z).ravel()])

    out = {}
    for name, flat in _summed(rows, part).items():
        k = (d + 1) ** 2
        xx, yz = flat[:k].reshape(d + 1, d + 1), flat[k:].reshape(len(classes[name]), d + 1)
        out[name] = xx, yz[:, 0], yz
    return out


def _scaling(xx: np.ndarray) -> np.ndarray:
    """The matrix that takes (1, x) to (1, standardised x); a constant feature is only centred."""
    n, mean = xx[0, 0], xx[0, 1:] / xx[0, 0]
    std = np.sqrt(np.maximum(np.diag(xx)[1:] / n - mean * mean, 0))
    std = np.where(std > 1e-12, std, 1.0)
    out = np.diag(np.concatenate([[1.0], 1 / std]))
    out[1:, 0] = -mean / std
    return out


def ridge(rows: DataFrame, penalty: float = 1.0) -> dict[str, Head]:
    """Heads that regress +-1 on the standardised features; the constant is not penalised."""
    rows, classes, d = _prepared(rows)
    out = {}
    for name, (xx, n, yz) in _moments(rows, classes, d).items():
        s = _scaling(xx)
        a = s @ xx @ s.T + penalty * np.diag([0.0] + [1.0] * d)
        b = s @ (2 * yz.T - xx[:, :1])
        out[name] = Head(classes[name], np.linalg.solve(a, b).T @ s)
    return out


@dataclass
class _Search:
    """Quasi-Newton search of one group, for weights (classes, 1 + dimensions) on standardised features."""

    scale: np.ndarray
    curve: np.ndarray
    penalty: np.ndarray
    w: np.ndarray
    trial: np.ndarray
    loss: float = np.inf
    grad: np.ndarray | None = None
    step: np.ndarray | None = None
    size: float = 1.0
    pairs: list = field(default_factory=list)
    passes: int = 0
    done: bool = False
    converged: bool = False

    def told(self, loss: float, grad: np.ndarray, tolerance: float) -> None:
        """The loss and gradient at ``trial``; sets the next ``trial``."""
        self.passes += 1
        grad = grad @ self.scale.T + self.penalty * self.trial
        loss += 0.5 * float((self.penalty * self.trial**2).sum())
        noise = 1e-12 * abs(loss)  # of sums in any order
        if self.grad is not None and loss > self.loss + noise + 1e-4 * self.size * float((self.grad * self.step).sum()) and self.size > 1e-6:
            self.size /= 2
            self.trial = self.w + self.size * self.step
            return
        if self.grad is not None:
            s, y = self.trial - self.w, grad - self.grad
            if (s * y).sum() > 1e-12 * (y * y).sum():
                self.pairs = [*self.pairs, (s, y)][-HISTORY:]
        stuck = self.grad is not None and loss >= self.loss - noise and np.abs(grad).max() >= np.abs(self.grad).max()
        self.w, self.loss, self.grad = self.trial, loss, grad
        self.converged = np.abs(grad).max() <= tolerance
        self.done = self.converged or stuck
        q, alphas = grad.copy(), []
        for s, y in reversed(self.pairs):
            alphas.append((s * q).sum() / (s * y).sum())
            q -= alphas[-1] * y
        q = q @ self.curve
        for (s, y), a in zip(self.pairs, reversed(alphas), strict=True):
            q += s * (a - (y * q).sum() / (s * y).sum())
        self.step, self.size = -q, 1.0
        self.trial = self.w + self.step


def logistic(rows: DataFrame, penalty: float = 1.0, tolerance: float = 1e-6, most: int = 200) -> dict[str, Head]:
    """Heads of greatest penalised likelihood: the sum of log losses plus half ``penalty`` times the squares of all weights but the constants.

    ``tolerance`` bounds the gradient's largest component. Rows are packed and written once; every pass reads the blocks.
    """
    rows, classes, d = _prepared(rows)
    searches: dict[str, _Search] = {}
    for name, (xx, _, _) in _moments(rows, classes, d).items():
        s, c = _scaling(xx), len(classes[name])
        pen = np.concatenate([[0.0], np.full(d, penalty)])
        bound = 0.5 * s @ xx @ s.T + np.diag(np.maximum(pen, 1e-9))
        searches[name] = _Search(s, np.linalg.inv(bound), np.broadcast_to(pen, (c, d + 1)), np.zeros((c, d + 1)), np.zeros((c, d + 1)))
    while open_ := [k for k, v in searches.items() if not v.done and v.passes < most]:
        weights = {k: (classes[k], searches[k].trial @ searches[k].scale) for k in open_}

        def part(groups, weights=weights):
            for names, labels, z in groups:
                for name in weights.keys() & set(names):
                    known, w = weights[name]
                    score = z @ w.T
                    top = score.max(1, keepdims=True)
                    e = np.exp(score - top)
                    total = e.sum(1, keepdims=True)
                    y = labels[:, None] == known[None, :]
                    loss = float((np.log(total) + top).sum() - score[y].sum())
                    yield name, np.concatenate([[loss], ((e / total - y).T @ z).ravel()])

        for name, flat in _summed(rows, part).items():
            searches[name].told(flat[0], flat[1:].reshape(-1, d + 1), tolerance)
    return {k: Head(classes[k], v.w @ v.scale, v.loss, v.passes, v.converged) for k, v in searches.items()}


def predicted(rows: DataFrame, heads: dict[str, Head], vector: str = "u", group: str = "grp") -> DataFrame:
    """``rows`` with ``predicted``: the class of the highest score (ties: the smallest); null for a group without a head.

    Where a row has an array of groups, an array of as many predictions.
    """
    cols = rows.columns
    at, by = cols.index(vector), cols.index(group)
    many = rows.schema[group].dataType.typeName() == "array"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(by)
            flat, of = (lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())) if many else (lists, np.arange(len(lists)))
            codes = flat.dictionary_encode()
            code = codes.indices.fill_null(len(codes.dictionary)).to_numpy()
            out, missing = np.zeros(len(flat), np.int64), np.ones(len(flat), bool)
            order = np.argsort(code, kind="stable")
            ends = np.searchsorted(code[order], np.arange(len(codes.dictionary) + 1))
            for k, name in enumerate(codes.dictionary.to_pylist()):
                if name in heads:
                    some, h = order[ends[k] : ends[k + 1]], heads[name]
                    x = _vectors(batch.column(at).take(pa.array(of[some])))
                    out[some] = h.classes[(h.weights[:, 0] + x @ h.weights[:, 1:].T).argmax(1)]
                    missing[some] = False
            found = pa.array(out, mask=missing)
            if many:
                found = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(lists) + 1)).astype(np.int32)), found)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*cols, "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, predicted {'array<long>' if many else 'long'}")
