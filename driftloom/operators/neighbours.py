"""Exact nearest neighbours of a stated query set, in blocks.

Vectors of a bank and of a query set travel as rows of packed blocks. A block of queries meets its key's bank blocks one after the other in one
task, which holds the queries, their k best so far and one bank block: only finished lists leave, one row for each query, and none are merged
afterwards. Products in single precision sort out the pairs that cannot be among the k best, by a bound on their error: of each short run of bank
rows only the largest product is kept; these tell how near k rows are at least, and which runs are worth a look, in double precision. The
groups of one key are as many as it has blocks of queries, and each is one task.

Queries may be a block of vectors under several conditions, made within the task. Conditions that only scale and move all vectors alike share the
products: the bank is put in the order of its products with the moves, so that those of a run differ little.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.sources.store import written

BLOCK = 2048
#: Half the vectors of a block of ``nearest`` (of queries under all conditions, and of the bank), sides of one product, bank rows whose largest product is taken at once.
NEAR_BLOCK, ROWS, TILE, RUN = 1 << 15, 512, 1024, 128
#: Queries that meet a bank block at once (at most 65,536), and rows of a query that are sorted side by side.
CHUNK, WIDE = 8192, 96
#: A move of so many times the vectors' length, and less, shares its products.
LONG = 2.0
#: More than this is not multiplied in single precision.
HUGE = 1e20
#: More than the error of an inner product in single precision, for each dimension and unit of both norms.
SINGLE = 2.0**-22
#: Pairs that are kept before they are merged into the lists.
PENDING = 1 << 20


def block_counts(rows: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """keys, blocks: how many blocks of about ``block`` vectors each key has."""
    return rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block))).cast("int").alias("blocks"))


def packed(rows: DataFrame, keys: Sequence[str], block: int = BLOCK, counts: DataFrame | None = None) -> DataFrame:
    """Rows (keys, tag, vec_id, label, u) in blocks of about ``block`` vectors: keys, tags, ids, labels, vectors. ``counts``: ``block_counts``, if known."""

    def pack(t: pa.Table) -> pa.Table:
        one = lambda c, kind: pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t[c].combine_chunks().cast(kind))
        values = t["u"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8")
        return pa.table({
            **{k: pa.array([t[k][0].as_py()], pa.string()) for k in keys},
            "block": pa.array([t["block"][0].as_py()], pa.int64()),
            "tags": one("tag", pa.string()),
            "ids": one("vec_id", pa.int64()),
            "labels": one("label", pa.int32()),
            "vectors": pa.array([values.tobytes()], pa.binary()),
        })

    dealt = rows.join(F.broadcast(block_counts(rows, keys, block) if counts is None else counts), list(keys)).withColumn("block", F.pmod(F.xxhash64("tag", "vec_id"), F.col("blocks")))
    schema = ", ".join(f"{k} string" for k in keys) + ", block long, tags array<string>, ids array<long>, labels array<int>, vectors binary"
    return dealt.select(*keys, "block", "tag", "vec_id", "label", "u").groupBy(*keys, "block").applyInArrow(pack, schema)


def block_pairs(q: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every block of ``q`` beside every block of ``b`` with its key, dealt evenly: a query block is sent to each bank block's place."""
    counts = b.groupBy(*keys).agg(F.max("block").alias("_last"))
    sent = q.join(counts, list(keys)).withColumn("b_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last")))).drop("_last")
    bank = b.select(*keys, F.col("block").alias("b_block"), F.col("ids").alias("b_ids"), F.col("labels").alias("b_labels"), F.col("vectors").alias("b_vectors"))
    return sent.join(bank, [*keys, "b_block"])


class _Block:
    """A packed row: ids, labels and vectors."""

    def __init__(self, batch: pa.RecordBatch, i: int) -> None:
        of = lambda c: batch.column(c)[i].values.to_numpy(zero_copy_only=False)
        self.ids, self.labels, self.tags = of("ids"), of("labels"), batch.column("tags")[i].values
        self.x = np.frombuffer(batch.column("vectors")[i].as_buffer(), "<f8").reshape(len(self.ids), -1)

    def some(self, which: np.ndarray) -> _Block:
        """The rows at these places."""
        new = object.__new__(_Block)
        new.ids, new.labels, new.tags, new.x = self.ids[which], self.labels[which], self.tags.take(pa.array(which)), self.x[which]
        return new


def joined(blocks: Sequence[_Block]) -> _Block:
    """The rows of all of these blocks."""
    if len(blocks) == 1:
        return blocks[0]
    new = object.__new__(_Block)
    new.ids, new.labels, new.x = (np.concatenate([getattr(b, name) for b in blocks]) for name in ("ids", "labels", "x"))
    new.tags = pa.concat_arrays([b.tags for b in blocks])
    return new


def _repeats(ids: np.ndarray) -> int:
    """How often the most frequent id comes."""
    return int(np.unique(ids, return_counts=True)[1].max())


def _ordered(k: int, own: bool = False):
    """Bank blocks by label, then id. Of equal vectors only the first few stay: k after one id's rows are left out; no list has another. ``own``: vectors are brought to length 1 first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = _Block(batch, i)
                order = np.lexsort((b.ids, b.labels))
                x = np.ascontiguousarray(unit_rows(b.x[order])[0] if own else b.x[order])
                raw = x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
                by = np.argsort(raw, kind="stable")
                head = np.flatnonzero(np.concatenate([[True], raw[by][1:] != raw[by][:-1]]))
                nth = np.arange(len(by)) - np.repeat(head, np.diff(np.append(head, len(by))))
                kept = np.sort(by[nth < k + _repeats(b.ids)])
                at = pa.array([0, len(kept)], pa.int32())
                row = batch.slice(i, 1)
                new = {"ids": pa.ListArray.from_arrays(at, pa.array(b.ids[order][kept])), "labels": pa.ListArray.from_arrays(at, pa.array(b.labels[order][kept])), "tags": pa.ListArray.from_arrays(at, b.tags.take(pa.array(order[kept]))), "vectors": pa.array([x[kept].tobytes()], pa.binary())}
                yield pa.RecordBatch.from_arrays([new.get(c, row.column(c)) for c in row.schema.names], names=row.schema.names)

    return run


class Shift(NamedTuple):
    """Block of queries under a condition: vectors ``y``. Where ``times`` is given, y = times * x + weight * along, with x the block itself and times at least 0."""

    tag: str
    y: np.ndarray
    times: float | None = None
    along: np.ndarray | None = None
    weight: float = 0.0


def unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows over their norms, and the norms; norms are 1e-12 at least."""
    size = np.maximum(np.sqrt((x * x).sum(1)), 1e-12)
    return x / size[:, None], size


class Lists:
    """The ``k`` best bank rows of each of a block of queries ``x``, after any number of bank blocks.

    ``near`` is ``x`` in single precision, whose products with the bank tell what those of x are, at least and at most: x is ``scale`` times ``near``
    plus ``shift`` times a direction. Lists with the same ``near`` meet a bank block together.
    """

    def __init__(self, q: _Block, k: int, other_than_self: bool, x: np.ndarray | None = None, tag: str | None = None, near: np.ndarray | None = None, scale: np.ndarray | None = None, shift: np.ndarray | None = None, along: int = -1) -> None:
        self.q, self.k, self.other, self.tag, self.along = q, k, other_than_self, tag, along
        self.x = q.x if x is None else x
        n = len(self.x)
        self.sim, self.ids, self.labels = np.full((n, k), -np.inf), np.zeros((n, k), np.int64), np.zeros((n, k), np.int32)
        self.single = self.x.astype("<f4")
        self.near = self.single if near is None else near
        self.norm = np.sqrt((self.x * self.x).sum(1))
        self.scale, self.shift, self.own_ids = scale, shift, q.ids
        #: Of all runs' largest products, as they are at least, the k largest: k different rows are at least as near as the least of them.
        self.peaks = np.full((n, k), -np.inf, "<f4")

    def of(self, chunk: slice) -> Lists:
        """The lists of some of the queries, which these share."""
        new = object.__new__(Lists)
        new.__dict__ |= self.__dict__
        for name in ("x", "single", "norm", "sim", "ids", "labels", "peaks", "scale", "shift", "own_ids"):
            if getattr(self, name) is not None:
                setattr(new, name, getattr(self, name)[chunk])
        return new

    def meet(self, b: _Block, single: np.ndarray, top: np.ndarray, run: int, spread: np.ndarray, size: float, first: np.ndarray) -> None:
        """Meet a bank block of which the largest product of each run of rows with ``near`` is known; ``spread``: least and largest product with each direction by run."""
        zero = np.flatnonzero(self.norm == 0)
        if len(zero):  # equally near to all: the first rows by label and id are its list
            self._merge(b, np.repeat(zero, len(first)), np.tile(first, len(zero)))
        least = most = top
        slack = SINGLE * b.x.shape[1] * size * self.norm
        with np.errstate(invalid="ignore", over="ignore"):
            if self.scale is not None:
                slack = SINGLE * b.x.shape[1] * size * (self.scale + np.abs(self.shift) + self.norm)
                least = most = top * self.scale.astype("<f4")
                if self.along >= 0:
                    one, two = (self.shift.astype("<f4")[None, :] * g[:, None] for g in spread[:, self.along].astype("<f4"))
                    least, most = most + np.minimum(one, two), most + np.maximum(one, two)
                far = self.scale > HUGE  # a shift that leaves next to nothing of its vector: all rows are looked at
                if far.any():
                    least, most = np.where(far, np.float32(-np.inf), least), np.where(far, np.float32(np.inf), most)
            least = np.ascontiguousarray(least.T)
            up = np.flatnonzero((least > self.peaks.min(1)[:, None]).any(1))
            self.peaks[up] = np.partition(np.concatenate([self.peaks[up], least[up]], axis=1), least.shape[1], axis=1)[:, -self.k :]
            floor = np.maximum(self.sim[:, -1], self.peaks.min(1) - slack) - slack
        floor[(self.norm == 0) | ~np.isfinite(self.norm)] = np.inf
        floor = np.nextafter(floor.astype("<f4"), np.float32(-np.inf))  # rounded down
        hit = np.flatnonzero(most >= floor)
        at, row = hit // most.shape[1], hit % most.shape[1]
        ends = np.searchsorted(at, np.arange(len(most) + 1))
        rows, cols, pending = [], [], 0
        for r in range(len(most)):
            bank = single[r * run : min((r + 1) * run, len(b.ids))]
            for s in range(ends[r], ends[r + 1], TILE):
                part = row[s : min(s + TILE, ends[r + 1])]
                found = np.flatnonzero(self.single[part] @ bank.T >= floor[part, None])
                rows.append(part[found // len(bank)])
                cols.append(found % len(bank) + r * run)
                pending += len(found)
            if rows and (pending > PENDING or r + 1 == len(most)):
                self._merge(b, np.concatenate(rows), np.concatenate(cols))
                rows, cols, pending = [], [], 0

    def _merge(self, b: _Block, rows: np.ndarray, cols: np.ndarray) -> None:
        if not len(rows):
            return
        sim = np.einsum("ij,ij->i", self.x[rows], b.x[cols])
        keep = np.isfinite(sim)
        if self.other:
            keep &= self.own_ids[rows] != b.ids[cols]
        keep &= sim >= self.sim[rows, -1]
        rows, cols, sim = rows[keep], cols[keep], sim[keep]
        if not len(rows):
            return
        hit = np.unique(rows)
        every = np.concatenate([np.repeat(hit, self.k), rows])
        value = np.concatenate([self.sim[hit].ravel(), sim])
        ids = np.concatenate([self.ids[hit].ravel(), b.ids[cols]])
        labels = np.concatenate([self.labels[hit].ravel(), b.labels[cols]])
        by = np.argsort(every.astype(np.uint16), kind="stable")
        ends = np.searchsorted(every[by], np.append(hit, every.max() + 1))
        width = int(np.diff(ends).max())
        if width <= WIDE:
            # few rows for each query: sorted side by side, and again by label and id only where products are equal
            nth = np.arange(len(by)) - np.repeat(ends[:-1], np.diff(ends))
            place = np.repeat(np.arange(len(hit)), np.diff(ends))
            side, which = np.full((len(hit), width), -np.inf), np.zeros((len(hit), width), np.int64)
            side[place, nth], which[place, nth] = value[by], by
            order = np.argsort(-side, axis=1)[:, : self.k + 1]
            found = np.take_along_axis(side, order, 1)
            best = np.take_along_axis(which, order[:, : self.k], 1)
            even = ((found[:, 1:] == found[:, :-1]) & np.isfinite(found[:, 1:])).any(1)
        else:
            best, even = np.zeros((len(hit), self.k), np.int64), np.ones(len(hit), bool)
        if even.any():
            some = by[np.repeat(even, np.diff(ends))]
            some = some[np.lexsort((ids[some], labels[some], -value[some], every[some]))]
            best[even] = some[np.searchsorted(every[some], hit[even])[:, None] + np.arange(self.k)[None, :]]
        self.sim[hit], self.ids[hit], self.labels[hit] = value[best], ids[best], labels[best]

    def rows(self, names: dict[str, str], votes: Sequence[int] = (), step: int = 8192) -> Iterator[pa.RecordBatch]:
        """One row for each query that has a neighbour."""
        for a in range(0, len(self.norm), step):
            found = np.isfinite(self.sim[a : a + step])
            some = np.flatnonzero(found[:, 0])
            ends = np.concatenate([[0], np.cumsum(found[some].sum(1))]).astype(np.int32)
            flat = lambda m: pa.array(m[a : a + step][found])
            near = pa.StructArray.from_arrays([flat(self.ids), flat(self.labels), flat(self.sim)], ["near_id", "near_label", "sim"])
            yield pa.RecordBatch.from_pydict({
                **{c: pa.array([v] * len(some), pa.string()) for c, v in names.items()},
                "tag": self.q.tags.take(pa.array(a + some)) if self.tag is None else pa.array([self.tag] * len(some), pa.string()),
                "vec_id": pa.array(self.q.ids[a + some]),
                "label": pa.array(self.q.labels[a + some]),
                "near": pa.ListArray.from_arrays(pa.array(ends), near),
                **{f"vote_{v}": pa.array(majority(self.labels[a : a + step][some], found[some], v)) for v in votes},
            })


    def sums(self, base: np.ndarray) -> tuple:
        """Columns of ``nearest_sums`` over these queries, which were ``base`` before they were moved."""
        found = np.isfinite(self.sim)
        some = found[:, 0]
        far = 1 - np.clip((self.x * base).sum(1), -1.0, 1.0)
        hits = int((self.labels[some, 0] == self.q.labels[some]).sum())
        return len(base), float(far.sum()), self.x.sum(0).tolist(), base.sum(0).tolist(), int(some.sum()), hits, float((1 - self.sim[some, 0]).sum()), int(found.sum()), float((1 - self.sim[found]).sum())


def majority(labels: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """The most frequent of the first ``k`` known labels of each row, ties to the smallest."""
    labels, known = labels[:, :k], known[:, :k]
    votes = ((labels[:, :, None] == labels[:, None, :]) & known[:, None, :]).sum(2)
    votes[~known] = 0
    return np.where(votes == votes.max(1, keepdims=True), labels, np.iinfo(np.int32).max).min(1).astype(np.int32)


class Group:
    """Queries of one task under all their conditions; lists that share products are kept together."""

    def __init__(self, q: _Block, k: int, other_than_self: bool, shifts: Callable[[np.ndarray, np.ndarray | None], Iterable[Shift]] | None = None, about: np.ndarray | None = None) -> None:
        self.q, self.k, self.other, self.base = q, k, other_than_self, q.x
        self.along: list[np.ndarray] = []
        if shifts is None:
            self.shared = [[Lists(q, k, other_than_self)]]
            self.lists = self.shared[0]
            return
        self.shared, self.lists, together = [], [], []
        with np.errstate(invalid="ignore", over="ignore"):
            self.base, size = unit_rows(q.x)
            single = self.base.astype("<f4")
            for s in shifts(q.x, about):
                x, norm = unit_rows(s.y)
                # a move much longer than the vectors themselves leaves bounds that are too wide to be of use
                if s.times is None or (s.along is not None and s.weight * np.linalg.norm(s.along) > LONG * s.times * np.median(size)):
                    self.lists.append(Lists(q, k, other_than_self, x, s.tag))
                    self.shared.append([self.lists[-1]])
                    continue
                at = -1
                if s.along is not None and s.weight:
                    at = next((i for i, v in enumerate(self.along) if np.array_equal(v, s.along)), len(self.along))
                    if at == len(self.along):
                        self.along.append(s.along)
                self.lists.append(Lists(q, k, other_than_self, x, s.tag, single, s.times * size / norm, s.weight / norm, at))
                together.append(self.lists[-1])
        if together:
            self.shared.append(together)

    def add(self, b: _Block) -> None:
        """Meet a bank block."""
        size = np.sqrt((b.x * b.x).sum(1))
        known = np.isfinite(size)
        if not known.all():
            b = b.some(np.flatnonzero(known))
        if not len(b.ids):
            return
        size = float(size[known].max())
        run = RUN if len(b.ids) >= 20 * self.k * RUN else RUN // 2
        while run > 1 and len(b.ids) < 4 * self.k * run:
            run //= 2
        runs = -(-len(b.ids) // run)
        if self.along:
            # rows of a run have nearly equal products with each direction: those that bounds depend on most are cut finest
            sides = np.stack([b.x @ v for v in self.along])
            wide = self._weights() * np.ptp(sides, axis=1)
            wide = np.where(wide > 0, wide, 1e-300)  # false for NaN, too
            share = np.exp(np.log(wide) - np.log(wide).mean()) * runs ** (1 / len(wide))
            *coarse, last = np.argsort(wide, kind="stable")
            parts = [np.argsort(np.argsort(sides[i], kind="stable")) * max(int(min(share[i], runs)), 1) // len(b.ids) for i in coarse]
            order = np.lexsort((sides[last], *parts))
            b, sides = b.some(order), sides[:, order]
            cut = np.arange(0, len(b.ids), run)
            spread = np.stack([np.minimum.reduceat(sides, cut, axis=1), np.maximum.reduceat(sides, cut, axis=1)])
            reach = max(1.0, float(np.abs(sides).max()) / max(size, 1e-300))  # products with directions count towards the error
        else:
            spread, reach = np.zeros((2, 0, runs)), 1.0
        first = np.lexsort((b.ids, b.labels))[: self.k + _repeats(b.ids)]
        single = np.zeros((runs * run, b.x.shape[1]), "<f4")
        single[: len(b.ids)] = b.x
        own = self._own(b) if self.other else None
        for lists in self.shared:
            for a in range(0, len(self.q.ids), CHUNK):
                self._meet(lists, slice(a, min(a + CHUNK, len(self.q.ids))), b, single, run, spread, size * reach, first, own)

    def _weights(self) -> np.ndarray:
        """How much of each direction a query's products have, in the condition that has most of it."""
        most = np.zeros(len(self.along))
        for lists in self.lists:
            if lists.along >= 0:
                known = np.abs(lists.shift[np.isfinite(lists.shift)])
                most[lists.along] = max(most[lists.along], float(np.median(known)) if len(known) else 0.0)
        return most

    def _own(self, b: _Block) -> tuple[np.ndarray, np.ndarray]:
        """Places (query, bank row) of equal ids, by query."""
        order = np.argsort(b.ids, kind="stable")
        ids = b.ids[order]
        lo, hi = np.searchsorted(ids, self.q.ids), np.searchsorted(ids, self.q.ids, "right")
        rows = np.repeat(np.arange(len(lo)), hi - lo)
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        return rows, order[lo[rows] + nth]

    def _meet(self, lists: list[Lists], chunk: slice, b: _Block, single: np.ndarray, run: int, spread: np.ndarray, size: float, first: np.ndarray, own: tuple | None) -> None:
        near = lists[0].near[chunk]
        n, top, space = len(near), np.empty((len(single) // run, len(near)), "<f4"), np.empty(ROWS * TILE, "<f4")
        for a in range(0, n, ROWS):
            e = min(a + ROWS, n)
            if own:
                some = slice(*np.searchsorted(own[0], [chunk.start + a, chunk.start + e]))
                rows, cols = own[0][some] - chunk.start - a, own[1][some]
            for c in range(0, len(single), TILE):
                bank = single[c : c + TILE]
                sim = space[: (e - a) * len(bank)].reshape(len(bank), e - a)
                np.matmul(bank, near[a:e].T, out=sim)
                sim[len(b.ids) - c :] = -np.inf  # rows that fill up the last run
                if own:
                    here = (cols >= c) & (cols < c + len(bank))
                    sim[cols[here] - c, rows[here]] = -np.inf
                sim.reshape(-1, run, e - a).max(1, out=top[c // run : (c + len(bank)) // run, a:e])
        for one in lists:
            one.of(chunk).meet(b, single, top, run, spread, size, first)


def _searched(
    queries: DataFrame,
    bank: DataFrame | None,
    keys: Sequence[str],
    k: int,
    other_than_self: bool,
    block: int,
    shifts: Callable[[np.ndarray, np.ndarray | None], Iterable[Shift]] | None,
    conditions: int,
    about: DataFrame | None,
    out: Callable[[Group, dict[str, str]], Iterable[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """What ``out`` makes of each group of queries after it has met its bank."""
    names = ["tags", "ids", "labels", "vectors"]
    many = max(2 * block // conditions, 1)
    if bank is None:
        # queries and bank are the same blocks: packed once, and counted as they were packed
        counts = None if about is None else about.select(*keys, F.ceil(F.col("n") / F.lit(float(many))).cast("int").alias("blocks"))
        held = written(packed(queries, keys, many, counts))
        q, b = held, held.mapInArrow(_ordered(k, own=True), held.schema)
        dealt = held.groupBy(*keys).agg((F.max("block") + 1).cast("int").alias("blocks"))
    else:
        q, b = packed(queries, keys, many), packed(bank, keys, 2 * block)
        b = written(b.mapInArrow(_ordered(k), b.schema))
        dealt = block_counts(queries, keys, many)
    q = q.select(*keys, F.col("block").alias("group"), F.lit(-1).cast("long").alias("part"), *names)
    q = q.withColumn("about", F.lit(None).cast("array<double>")) if about is None else q.join(F.broadcast(about.select(*keys, F.col("m").alias("about"))), list(keys), "left")
    # one row for each key: its groups and how many groups the keys before it have
    before = F.sum("blocks").over(Window.orderBy(*keys)) - F.col("blocks")
    groups = written(dealt.withColumn("before", before))
    parts = max(groups.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0], 1)
    sent = b.join(F.broadcast(groups.drop("before")), list(keys)).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    sent = sent.select(*keys, "group", F.col("block").alias("part"), *names, F.lit(None).cast("array<double>").alias("about"))
    # bank blocks follow their queries; a group is one task's work, so each has a partition of its own
    both = q.unionByName(sent).join(F.broadcast(groups.drop("blocks")), list(keys)).withColumn("place", (F.col("before") + F.col("group")).cast("int")).drop("before")
    both = both.repartitionById(parts, F.col("place")).drop("place").sortWithinPartitions(*keys, "group", "part")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, now, met = None, None, []

        def finished() -> Iterator[pa.RecordBatch]:
            if made:
                meet()
                yield from out(made, now[0])

        def meet() -> None:
            if met:
                made.add(joined(met))
                met.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                name = {c: batch.column(c)[i].as_py() for c in keys}
                if batch.column("part")[i].as_py() < 0:
                    yield from finished()
                    m = batch.column("about")[i].as_py()
                    made, now = Group(_Block(batch, i), k, other_than_self, shifts, None if m is None else np.array(m, float)), (name, batch.column("group")[i].as_py())
                elif now == (name, batch.column("group")[i].as_py()):  # a group may have no queries
                    b = _Block(batch, i)
                    if sum(len(other.ids) for other in met) + len(b.ids) > 2 * block:
                        meet()
                    met.append(b)
        yield from finished()

    return both.mapInArrow(run, ", ".join(f"{key} string" for key in keys) + ", " + schema)


def nearest_lists(
    queries: DataFrame,
    bank: DataFrame | None,
    keys: Sequence[str],
    k: int,
    other_than_self: bool = False,
    block: int = NEAR_BLOCK,
    shifts: Callable[[np.ndarray, np.ndarray | None], Iterable[Shift]] | None = None,
    conditions: int = 1,
    about: DataFrame | None = None,
    votes: Sequence[int] = (),
) -> DataFrame:
    """keys, tag, vec_id, label, near: an array of (near_id, near_label, sim), at most k, by cosine (inputs are unit vectors), ties by label, then id.

    With ``shifts``, ``queries`` holds vectors as they are, one row for all ``conditions``, which are made, brought to length 1 and searched in the
    task that has the block; ``about`` (keys, m: a few rows) is given to them. ``votes`` adds the majority of the first n labels as ``vote_n``.
    With no ``bank``, the queries' own vectors, brought to length 1, are searched; ``about`` then has the number ``n`` of each key's vectors, too.
    """

    def out(made: Group, name: dict[str, str]) -> Iterator[pa.RecordBatch]:
        for lists in made.lists:
            yield from lists.rows(name, votes)

    schema = "tag string, vec_id long, label int, near array<struct<near_id: long, near_label: int, sim: double>>" + "".join(f", vote_{v} int" for v in votes)
    return _searched(queries, bank, keys, k, other_than_self, block, shifts, conditions, about, out, schema)


def nearest_sums(queries: DataFrame, keys: Sequence[str], k: int, shifts: Callable[[np.ndarray, np.ndarray | None], Iterable[Shift]], conditions: int, about: DataFrame, block: int = NEAR_BLOCK) -> DataFrame:
    """Sums over each group of queries and condition, a few rows for each key, instead of ``nearest_lists`` of the queries' own vectors.

    keys, tag; n, far, u, c: vectors, their sum of 1 - cosine to the vector as it was, and both sums of unit vectors; found, hits, first: queries with a
    list, those whose first neighbour has their label, and the sum of 1 - sim to it; listed, whole: neighbours of all lists, and the sum of 1 - sim to them.
    """
    kinds = [pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64()]

    def out(made: Group, name: dict[str, str]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([
            *[pa.array([v] * len(made.lists), pa.string()) for v in name.values()],
            pa.array([lists.tag for lists in made.lists], pa.string()),
            *[pa.array(v, kind) for v, kind in zip(zip(*[lists.sums(made.base) for lists in made.lists], strict=True), kinds, strict=True)],
        ], names=[*name, "tag", "n", "far", "u", "c", "found", "hits", "first", "listed", "whole"])

    schema = "tag string, n long, far double, u array<double>, c array<double>, found long, hits long, first double, listed long, whole double"
    return _searched(queries, None, keys, k, False, block, shifts, conditions, about, out, schema)


def ranked(lists: DataFrame) -> DataFrame:
    """Lists of neighbours as one row for each neighbour: rank, near_id, near_label, sim in the place of ``near``."""
    rows = lists.select(*[c for c in lists.columns if c != "near"], F.posexplode("near").alias("pos", "n"))
    return rows.select(*[c for c in lists.columns if c != "near"], "n.near_id", "n.near_label", "n.sim", (F.col("pos") + 1).alias("rank"))


def nearest(queries: DataFrame, bank: DataFrame, keys: Sequence[str], k: int, other_than_self: bool = False, block: int = NEAR_BLOCK) -> DataFrame:
    """keys, tag, vec_id, label, rank, near_id, near_label, sim: ``nearest_lists`` as rows."""
    return ranked(nearest_lists(queries, bank, keys, k, other_than_self, block))


def similarities(queries: DataFrame, bank: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, tag, vec_id, n, mean, most, least: of every query's cosines to all rows of the bank (inputs are unit vectors).

    Of each pair of blocks one row for each query leaves, whatever the size of the bank; these are merged by query.
    """
    q, b = packed(queries, keys), packed(bank, keys)
    both = block_pairs(q, written(b), keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                n = len(r["ids"])
                x = np.frombuffer(r["vectors"], "<f8").reshape(n, -1)
                y = np.frombuffer(r["b_vectors"], "<f8").reshape(-1, x.shape[1])
                for a in range(0, n, 256):
                    sim = x[a : a + 256] @ y.T
                    m = len(sim)
                    yield pa.RecordBatch.from_pydict({
                        **{key: pa.array([r[key]] * m, pa.string()) for key in keys},
                        "tag": pa.array(r["tags"][a : a + m], pa.string()),
                        "vec_id": pa.array(r["ids"][a : a + m], pa.int64()),
                        "n": pa.array(np.full(m, len(y))),
                        "total": pa.array(sim.sum(1)),
                        "most": pa.array(sim.max(1)),
                        "least": pa.array(sim.min(1)),
                    })

    schema = ", ".join(f"{key} string" for key in keys) + ", tag string, vec_id long, n long, total double, most double, least double"
    found = both.mapInArrow(run, schema).groupBy(*keys, "tag", "vec_id")
    return found.agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), F.max("most").alias("most"), F.min("least").alias("least"))
