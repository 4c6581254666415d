"""Near-dedup by SetSketch registers.

Documents are sets of hashed word shingles. A set's sketch has ``M`` registers: register i is the truncated exponent, to base ``BASE``,
of the least of its elements' exponential variates under hash i. Sketches of parts merge by the larger register, and
equal registers are the likelier the more alike two sets are. Rows with equal sets form a class; links are sought between classes.

1. Sketches. One scan of the texts leaves a row (id, size, name of the set, registers) of about 200 bytes.
2. Bands. ``BANDS`` bands of ``ROWS`` registers name buckets. Two sets at the threshold share none with a chance of (1 - 0.85**5)**32,
   7e-9, which is all that a link is lost by; more alike sets have less.
3. Estimates. For two sketches the registers that are larger, smaller and equal give the likelihood of each Jaccard similarity, as
   sizes are known; its maximum is the estimate. A pair goes on if that is not ``DEVIATIONS`` standard deviations below the threshold.
   First every member of a bucket is held against the bucket's leader; buckets whose members these pairs connect are done, and in
   the others all members of different components are compared, in blocks, and a spanning forest of the likely pairs is kept.
4. Shards. Components of likely pairs: every link lies within one. Their classes' full sets are fetched once.
5. Verification on full sets, in blocks of a shard: likely pairs, the likeliest first, are counted exactly unless verified links connect
   them already. Blocks are held against themselves and the shard's first; then only what is outside a
   shard's largest component meets the rest.
6. Components of the verified links.

No group's pairs are emitted, no bucket, shard or partner list is capped, and no task holds more than two blocks.
Overlaps are counted on 64-bit hashes of shingles (a wrong count has a chance of about 10**6 / 2**64 for two documents of a thousand shingles).

Defined results: ids may be null or repeat, and rows with the smallest id of their component are all kept; a text without words (or null) has an empty
set and is its own component; a text with fewer words than a shingle is one shingle; a component without any id has none and its rows are kept; a
very long text is sketched in pieces, but its set is held by one task; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import materialise
from .shingles import shingle_sets
from .textarrays import mix, runs, tidy, utf8

WORDS, PERCENT = 5, 85
BANDS, ROWS = 32, 5
M = BANDS * ROWS
#: Base of the exponents, rate of the variates, and the largest register but one: sets of one to a billion elements are in range.
BASE, RATE, LARGEST = 1.15, 20.0, 254
DEVIATIONS = 6.0
#: Sets of one block, and elements that are hashed at once.
BLOCK, PIECE = 512, 1 << 15

_FACTORS = mix(np.arange(1, M + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
_LAST = np.uint64(0xD6E8FEB86659FD93)


def least_hashes(elements: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each set ``elements[ends[k]:ends[k+1]]`` the least of its elements' 64-bit hashes under each of the M functions."""
    least = np.full((len(ends) - 1, M), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(elements), PIECE):
        part = elements[lo : lo + PIECE]
        hi = lo + len(part)
        first, last = np.searchsorted(ends, lo, "right") - 1, np.searchsorted(ends, hi, "left")
        rows = np.arange(first, last)
        rows = rows[ends[rows] < ends[rows + 1]]  # empty sets have no place in the piece
        heads = np.maximum(ends[rows] - lo, 0)
        a, b = np.empty_like(part), np.empty_like(part)
        for i in range(M):
            np.multiply(part, _FACTORS[i], out=a)
            np.right_shift(a, np.uint64(32), out=b)
            np.bitwise_xor(a, b, out=a)
            np.multiply(a, _LAST, out=a)
            least[rows, i] = np.minimum(least[rows, i], np.minimum.reduceat(a, heads))
    return least


def registers(least: np.ndarray) -> np.ndarray:
    """Truncated exponents of the variates that least hashes stand for."""
    variate = -np.log1p(-(least.astype(np.float64) + 0.5) * 2.0**-64 * (1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(variate) / math.log(BASE)), 0, LARGEST + 1).astype(np.uint8)


def sketch(elements: np.ndarray) -> np.ndarray:
    return registers(least_hashes(elements, np.array([0, len(elements)])))[0] if len(elements) else np.zeros(M, np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of a union."""
    return np.maximum(a, b)


def _larger(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chance that one register is the larger, if a part x of the union is in its set alone; and its derivative."""
    c = (BASE - 1) / BASE
    left = np.maximum(1 - np.clip(x, 0, 1) * c, 1e-12)
    return np.maximum(-np.log(left) / math.log(BASE), 1e-12), c / left / math.log(BASE)


def estimate(more: np.ndarray, less: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarities of greatest likelihood for pairs of sets with sizes n and m, of whose registers ``more`` are larger and ``less`` smaller."""
    u = n / (n + m)
    v = 1 - u
    equal = M - more - less
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):  # the likelihood is concave: halve towards where its derivative changes sign
        j = (lo + hi) / 2
        (p, dp), (q, dq) = _larger(u - v * j), _larger(v - u * j)
        slope = -more * v * dp / p - less * u * dq / q + equal * (v * dp + u * dq) / np.maximum(1 - p - q, 1e-12)
        lo, hi = np.where(slope > 0, j, lo), np.where(slope > 0, hi, j)
    return (lo + hi) / 2


def likely(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Estimates for row pairs of registers, -1 where a link is out of the question."""
    least = percent / 100
    out = np.full(len(n), -1.0)
    fit = np.flatnonzero(100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    if len(fit):
        x, y = a[fit], b[fit]
        got = estimate((x > y).sum(1), (x < y).sum(1), n[fit].astype(float), m[fit].astype(float))
        out[fit] = np.where(got >= least - DEVIATIONS * math.sqrt(least * (1 - least) / M), got, -1.0)
    return out


def likely_pairs(a: np.ndarray, n: np.ndarray, la: np.ndarray, b: np.ndarray, m: np.ndarray, lb: np.ndarray, percent: int, within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the likely pairs with different labels, between two lists or ``within`` one, the likeliest first."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    every = np.arange(len(b))
    for i in range(len(a)):
        j = every[i + 1 :] if within else every
        j = j[lb[j] != la[i]]
        j = j[100 * np.minimum(n[i], m[j]) >= percent * np.maximum(n[i], m[j])]
        # equal registers are at least so many, but for chance, at the threshold
        j = j[(b[j] == a[i]).sum(1) >= M * (percent / 100 - DEVIATIONS * math.sqrt(percent * (100 - percent) / M) / 100)]
        if len(j):
            got = likely(np.broadcast_to(a[i], (len(j), M)), np.full(len(j), n[i]), b[j], m[j], percent)
            some = got > 0
            found.append((np.full(int(some.sum()), i), j[some], got[some]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    i, j, got = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(-got, kind="stable")
    return i[order], j[order], got[order]


class Links:
    """Which nodes are connected so far; nodes with equal labels are from the start."""

    def __init__(self, labels: list):
        seen: dict = {}
        self.parent = [seen.setdefault(x, k) for k, x in enumerate(labels)]

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Connect two nodes; False if they were."""
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of all intersections of two lists of sets: products of 0/1 matrices over slices of the elements that both sides have."""
    x, y = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(np.unique(x), np.unique(y), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    places = []
    for values, sets in ((x, left), (y, right)):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(shared, values), max(len(shared) - 1, 0))
        there = shared[at] == values if len(shared) else np.zeros(len(values), bool)
        order = np.argsort(at[there], kind="stable")
        places.append((owner[there][order], at[there][order]))
    for lo in range(0, len(shared), 4096):
        maps = []
        for (owner, at), sets in zip(places, (left, right), strict=True):
            a, e = np.searchsorted(at, [lo, lo + 4096])
            one = np.zeros((len(sets), min(4096, len(shared) - lo)), np.float32)
            one[owner[a:e], at[a:e] - lo] = 1
            maps.append(one)
        out += maps[0] @ maps[1].T  # whole numbers below 2**24 are exact
    return out


def linked(overlap: int, both: int, percent: int) -> bool:
    """Does an overlap of two sets, of so many elements in sum, make a link?"""
    return 100 * int(overlap) >= percent * (int(both) - int(overlap))


def verified(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray, links: Links, shift: int, percent: int) -> list[tuple[int, int]]:
    """Of the pairs (i, j) those that are links and connect what the ones before have not."""
    found: list[tuple[int, int]] = []
    counts, tried = None, 0
    slices = sum(len(s) for s in left) / 4096  # at most: elements that are shared are fewer
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        if links.find(p) == links.find(q + shift):
            continue
        tried += 1
        if counts is None and tried > 64 + 2000 * slices and max(len(s) for s in left) < 1 << 24:  # by now all counts at once are cheaper
            counts = overlaps(left, right)
        overlap = counts[p, q] if counts is not None else len(np.intersect1d(left[p], right[q], assume_unique=True))
        if linked(overlap, len(left[p]) + len(right[q]), percent):
            links.join(p, q + shift)
            found.append((p, q))
    return found


def _scan(words: int):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Arrow batches of (doc_id, text) to (doc_id, n, name, registers)."""
        for batch in batches:
            data, at = utf8(batch.column(1))
            for i, j in runs(at):
                sets = list(shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], words))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *_described(sets)], ["doc_id", "n", "name", "registers"])

    return scan


def _described(sets: list[np.ndarray]) -> list[pa.Array]:
    sizes = np.array([len(s) for s in sets], np.int64)
    whole = np.concatenate(sets)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    names = []
    for salt in (0x71D67FFFEDA60000, 0xFFF7EEE000000000):  # two sums of scrambled hashes name a set
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(whole ^ np.uint64(salt)))])
        names.append(mix(sums[ends[1:]] - sums[ends[:-1]]))
    names = np.stack(names, axis=1)
    regs = registers(least_hashes(whole, ends))
    return [pa.array(sizes), pa.array([x.tobytes() for x in names], pa.binary()), pa.array([x.tobytes() if n else None for x, n in zip(regs, sizes, strict=True)], pa.binary())]


def _full(words: int):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts to (name, registers, elements)."""
        for batch in batches:
            data, at = utf8(batch.column(0))
            for i, j in runs(at):
                sets = list(shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], words))
                yield pa.RecordBatch.from_arrays([*_described(sets)[1:], pa.array([s.tobytes() for s in sets], pa.binary())], ["name", "registers", "elements"])

    return scan


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, M)


def _estimated(percent: int):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (a, b, n, m, registers of a, registers of b) to the likely pairs."""
        for batch in batches:
            n, m = (batch.column(k).to_numpy() for k in (2, 3))
            got = likely(_matrix(batch.column(4)), n, _matrix(batch.column(5)), m, percent) if len(n) else np.zeros(0)
            keep = pa.array(got > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return scan


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    side = table["side"].to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return left, right if len(right) else left, not len(right)


def _forest(percent: int):
    def task(table: pa.Table) -> pa.Table:
        """Of one block of a bucket, or two: a spanning forest of the likely pairs."""
        left, right, within = _sides(table)
        name, n, regs = table["name"].to_pylist(), table["n"].to_numpy(), _matrix(table["registers"])
        labels = table["label"].to_pylist()
        code = np.unique(np.array([x.hex() for x in labels]), return_inverse=True)[1]
        i, j, _ = likely_pairs(regs[left], n[left], code[left], regs[right], n[right], code[right], percent, within)
        links = Links(labels)
        found = [(left[p], right[q]) for p, q in zip(i, j, strict=True) if links.join(int(left[p]), int(right[q]))]
        return pa.table({"a": pa.array([name[x] for x, _ in found], pa.binary()), "b": pa.array([name[y] for _, y in found], pa.binary())})

    return task


def _verify(percent: int):
    def task(table: pa.Table) -> pa.Table:
        """Of one block of a shard, or two: links, until they connect all that is linked."""
        left, right, within = _sides(table)
        name, regs = table["name"].to_pylist(), _matrix(table["registers"])
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table["elements"]]
        labels = table["label"].to_pylist()
        code = np.unique(np.array([x.hex() for x in labels]), return_inverse=True)[1]
        n = np.array([len(s) for s in sets])
        i, j, _ = likely_pairs(regs[left], n[left], code[left], regs[right], n[right], code[right], percent, within)
        links = Links([labels[k] for k in left] + ([] if within else [labels[k] for k in right]))
        found = verified([sets[k] for k in left], [sets[k] for k in right], i, j, links, 0 if within else len(left), percent)
        return pa.table({"a": pa.array([name[left[p]] for p, _ in found], pa.binary()), "b": pa.array([name[right[q]] for _, q in found], pa.binary())})

    return task


def _in_blocks(members: DataFrame, group: str, more: list[str]) -> DataFrame:
    """Members (group, blocks, block, name, ...) as the sides of every block by itself and every pair of different blocks."""
    cols = [group, "i", "j", "side", *more]
    own = members.select("*", F.col("block").alias("i"), F.col("block").alias("j"), F.lit(0).alias("side")).select(*cols)
    as_left = members.filter("block < blocks - 1").select("*", F.col("block").alias("i"), F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side")).select(*cols)
    as_right = members.filter("block > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side")).select(*cols)
    return own.unionByName(as_left).unionByName(as_right)


def _blocks(n: str) -> Column:
    return F.ceil(F.col(n) / F.lit(float(BLOCK))).cast("int")


def _likely_links(classes: DataFrame, percent: int, owner: str) -> DataFrame:
    """(a, b): pairs of classes that may be linked, enough to connect all that are."""
    key = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("registers", k * ROWS + 1, F.lit(ROWS))))
    bands = materialise(classes.select(F.explode(key).alias("band"), "name"), owner)
    sizes = bands.groupBy("band").agg(F.min("name").alias("lead"), F.max("name").alias("last"), F.count(F.lit(1)).alias("members")).filter("members > 1 AND lead <> last")
    sizes = materialise(sizes.select("band", "lead", "members"), owner)
    pairs = bands.join(sizes, "band").filter("name <> lead").select(F.col("name").alias("a"), F.col("lead").alias("b")).distinct()
    x = classes.select(F.col("name").alias("a"), F.col("n").alias("n"), F.col("registers").alias("x"))
    y = classes.select(F.col("name").alias("b"), F.col("n").alias("m"), F.col("registers").alias("y"))
    star = pairs.join(x, "a").join(y, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(tidy(_estimated(percent)), "a binary, b binary")
    star = materialise(star, owner)
    # in a bucket of two, the leader's pairs are all
    large = bands.join(sizes.filter("members > 2").select("band", "members"), "band")
    labels = components(star, owner).select(F.col("node").alias("name"), F.col("root").alias("label"))
    large = materialise(large.join(labels, "name", "left").withColumn("label", F.coalesce("label", "name")), owner)
    still = large.groupBy("band").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("band")
    members = large.join(still, "band").withColumn("blocks", _blocks("members")).withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    members = members.join(classes.select("name", "n", "registers"), "name")
    forest = _in_blocks(members, "band", ["name", "n", "registers", "label"]).groupBy("band", "i", "j").applyInArrow(tidy(_forest(percent)), "a binary, b binary")
    return star.unionByName(materialise(forest, owner))


def _verified_links(full: DataFrame, shards: DataFrame, percent: int, owner: str) -> DataFrame:
    """Links within shards (name, shard); ``full`` has (name, registers, elements)."""
    sizes = shards.groupBy("shard").agg(F.count(F.lit(1)).alias("members"))
    leaves = shards.join(sizes, "shard").withColumn("blocks", _blocks("members")).withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    leaves = materialise(leaves.join(full, "name").select("shard", "blocks", "block", "name", "registers", "elements"), owner)
    cols, schema = ["shard", "i", "j", "side", "name", "registers", "elements", "label"], "a binary, b binary"
    named = leaves.withColumn("label", F.col("name"))
    own = named.select("*", F.col("block").alias("i"), F.col("block").alias("j"), F.lit(0).alias("side")).select(*cols)
    # each other block against the shard's first
    first = named.filter("block = 0 AND blocks > 1").select("*", F.lit(0).alias("i"), F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side")).select(*cols)
    others = named.filter("block > 0").select("*", F.lit(0).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side")).select(*cols)
    links = materialise(own.unionByName(first).unionByName(others).groupBy("shard", "i", "j").applyInArrow(tidy(_verify(percent)), schema), owner)
    split = leaves.filter("blocks > 1")
    if split.isEmpty():
        return links
    sofar = components(links, owner).select(F.col("node").alias("name"), F.col("root").alias("label"))
    where = materialise(split.select("shard", "blocks", "name").join(sofar, "name", "left").withColumn("label", F.coalesce("label", "name")), owner)
    counts = where.groupBy("shard", "label").agg(F.count(F.lit(1)).alias("k"))
    main = counts.groupBy("shard").agg(F.max(F.struct("k", "label")).alias("main"), F.sum("k").alias("all"))
    main = main.select("shard", F.col("main.label").alias("main"), (F.col("all") - F.col("main.k")).alias("outside")).filter("outside > 0")
    where = materialise(where.join(main, "shard").select("shard", "name", "label", "main", _blocks("outside").alias("groups")), owner)
    # what is outside the largest component, in blocks, against all blocks of the shard
    rest = leaves.join(where.drop("shard"), "name")
    outside = rest.filter("label <> main").select("*", F.pmod(F.xxhash64("name", F.lit(1)), F.col("groups")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side"))
    inside = rest.select("*", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"))
    more = outside.select(*cols).unionByName(inside.select(*cols)).groupBy("shard", "i", "j").applyInArrow(tidy(_verify(percent)), schema)
    return links.unionByName(materialise(more, owner))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, owner: str = "query") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each input row."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = materialise(rows.mapInArrow(tidy(_scan(words)), "doc_id long, n long, name binary, registers binary"), owner)
    # the smaller of two different linked sets has so many elements at least
    least = -(-percent // (100 - percent)) if percent < 100 else None
    empty = found.filter("false").select(F.col("name").alias("a"), F.col("name").alias("b"))
    links = empty
    if least is not None:
        classes = found.filter(F.col("n") >= least).groupBy("name").agg(F.max("n").alias("n"), F.first("registers").alias("registers"), F.min("doc_id").alias("doc_id"))
        classes = materialise(classes, owner)
        shards = components(_likely_links(classes, percent, owner), owner).select(F.col("node").alias("name"), F.col("root").alias("shard"))
        if not shards.isEmpty():
            shards = materialise(shards.join(classes.select("name", "doc_id"), "name"), owner)
            # texts of the classes in shards; a class whose rows have no id is among the rows without one
            ids = shards.select(F.col("doc_id").alias("its_id")).distinct()
            texts = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("its_id")), "left_semi").select("text")
            full = texts.mapInArrow(tidy(_full(words)), "name binary, registers binary, elements binary").join(shards.select("name"), "name", "left_semi")
            full = full.groupBy("name").agg(F.first("registers").alias("registers"), F.first("elements").alias("elements"))
            links = _verified_links(full, shards.select("name", "shard"), percent, owner)
    group = components(links, owner).select(F.col("node").alias("name"), F.col("root").alias("to"))
    named = found.filter("n > 0").select("doc_id", "n", "name").join(group, "name", "left").withColumn("component", F.coalesce("to", "name"))
    # written first, so that the join's own exchange can be split where one component holds much of the table
    smallest = materialise(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), owner)
    out = named.join(smallest, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = out.unionByName(found.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
