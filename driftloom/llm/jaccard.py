"""N-gram Jaccard join by signature trees.

Documents are sets of hashed word shingles. Rows with equal sets form a class; links are sought between classes.

1. Document frequencies. Each chunk of texts sends its hashes, packed and sorted, to buckets by their leading bits; a bucket
   tells every chunk which of its hashes occur in another document too, and in how many. Hashes of one document alone
   can't be in any overlap, so from here a set is its size and its shared hashes.
2. Shards. In the order of rising frequency, two linked sets have a hash in common among the first
   n - ceil(0.75 n) + 1 of each. Sets that are connected by such hashes make a shard: every link lies within one.
3. Signature trees. A shard's sets, in order of size, are the leaves of a tree whose nodes hold the OR of their
   bitmaps and their range of sizes. A dual traversal goes down pairs of nodes, dropping those whose largest possible
   overlap (bits in common, plus the hashes that share a bit) is below the smallest that a link needs, or whose sizes
   are too far apart. Pairs that survive are counted exactly, unless they are known to be connected already.
   A shard of more than ``BLOCK`` sets is split: first each block within itself and against the first block, then the
   pairs of blocks that those links have not already connected as a whole.
4. Components of the links, over written tables.

Nothing is dropped, capped or sampled, and no group's pairs are emitted: links stop once they connect.

Overlaps are counted on 64-bit hashes of shingles, whatever the number of buckets. Two documents of a thousand shingles each get a
wrong count with a chance of about 10**6 / 2**64, and then are off by one, which matters only at the threshold itself. A set's name
is 128 bits.

Defined results: ids may be null or repeat; ties don't arise (the smallest id names a component); a very long text is hashed in pieces
but its set is held by one task; a text without words (or null) has an empty set, is linked with nothing and is its own component;
repeated rows are members of one class; of a component without any non-null doc_id the id is null; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import materialise, steady
from .shingles import shingle_sets
from .textarrays import mix, runs, tidy, utf8

WORDS, PERCENT = 5, 75
#: Sets of one block of a shard; leaves of a node.
BLOCK, FAN = 512, 8
#: Bytes of text and rows of one chunk.
CHUNK, ROWS = 1 << 21, 60_000
#: Bits of the step from one hash to the next that are kept beside the row's place in its chunk.
_STEP = np.uint64(48)
_LOW16 = np.uint64(0xFFFF)


def pack(keys: np.ndarray, owners: np.ndarray) -> bytes:
    """Sorted keys of up to 64 bits and owners below 65,535, in 8 bytes each: steps between keys; a step over 48 bits takes an entry more."""
    step = np.diff(keys, prepend=np.uint64(0))
    low, high = step & np.uint64((1 << 48) - 1), step >> _STEP
    extra = (high > 0).astype(np.int64)
    place = np.arange(len(keys)) + np.cumsum(extra)
    out = np.empty(len(keys) + int(extra.sum()), np.uint64)
    out[place] = low << np.uint64(16) | owners
    far = np.flatnonzero(extra)
    out[place[far] - 1] = high[far] << np.uint64(16) | _LOW16
    return out.tobytes()


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What ``pack`` was given."""
    packed = np.frombuffer(raw, np.uint64)
    owner, step = packed & _LOW16, packed >> np.uint64(16)
    keys = np.cumsum(np.where(owner == _LOW16, step << _STEP, step))
    some = owner != _LOW16
    return keys[some], owner[some]


def _chunks(bits: int, words: int):
    """Arrow batches of (doc_id, text) to rows (chunk, bucket, n, packed): packed hashes of a bucket, or the documents at a bucket below 0."""
    shift = np.uint64(64 - bits)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, at = utf8(batch.column(1))
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
            null = ~np.asarray(batch.column(0).is_valid())
            for lo in range(0, batch.num_rows, ROWS):
                hi = min(batch.num_rows, lo + ROWS)
                for i, j in ((lo + a, lo + b) for a, b in runs(at[lo : hi + 1], CHUNK)):
                    sets = list(shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], words))
                    sizes = np.array([len(s) for s in sets], np.int64)
                    # two sums of scrambled hashes name a set
                    whole = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                    ends = np.concatenate([[0], np.cumsum(sizes)])
                    names = []
                    for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47):
                        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(whole ^ np.uint64(salt)))])
                        names.append(mix(sums[ends[1:]] - sums[ends[:-1]]))
                    head = np.stack([ids[i:j].view("<u8"), null[i:j].astype("<u8"), sizes.astype("<u8"), *names], axis=1)
                    chunk = head.tobytes()
                    # the same in a task's second run, and no other chunk's
                    name, made = f"{task}/{made}", made + 1
                    order = np.argsort(whole, kind="stable")
                    whole, owner = whole[order], np.repeat(np.arange(len(sets), dtype=np.uint64), sizes)[order]
                    keys = whole & np.uint64((1 << (64 - bits)) - 1)
                    bucket = (whole >> shift).astype(np.int64)
                    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
                    parts = [pack(keys[a:e], owner[a:e]) for a, e in zip(cut, [*cut[1:], len(keys)][: len(cut)], strict=True)]
                    yield pa.RecordBatch.from_pydict({
                        "chunk": pa.array([name] * (len(parts) + 1)),
                        "bucket": pa.array([-1 - task, *bucket[cut].tolist()], pa.int32()),
                        "packed": pa.array([chunk, *parts], pa.binary()),
                    })

    return scan


def _shared(bits: int):
    def task(table: pa.Table) -> pa.Table:
        """Of one bucket: for each chunk the packed hashes that occur in more than one document, with how many."""
        if table["bucket"][0].as_py() < 0:  # documents pass
            return table.append_column("df", pa.nulls(table.num_rows, pa.binary()))
        parts = [unpack(x.as_py()) for x in table["packed"]]
        ends = np.concatenate([[0], np.cumsum([len(k) for k, _ in parts])])
        values = np.concatenate([k for k, _ in parts])
        order = np.argsort(values, kind="stable")
        sorted_values = values[order]
        head = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
        size = np.diff(np.append(head, len(values)))
        df = np.zeros(len(values), "<u4")
        df[order] = np.repeat(np.minimum(size, 0xFFFFFFFF), size)
        chunks, out, counts = [], [], []
        for k, (keys, owners) in enumerate(parts):
            mine = df[ends[k] : ends[k + 1]]
            keep = mine > 1
            if keep.any():
                chunks.append(table["chunk"][k].as_py())
                out.append(pack(keys[keep], owners[keep]))
                counts.append(mine[keep].tobytes())
        return pa.table({"chunk": pa.array(chunks, pa.string()), "bucket": pa.array([table["bucket"][0].as_py()] * len(chunks), pa.int32()), "packed": pa.array(out, pa.binary()), "df": pa.array(counts, pa.binary())})

    return task


def first_hashes(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many hashes of a set of n, rarest first, hold one of every linked set's."""
    return n - (percent * n + 99) // 100 + 1


def _documents(bits: int, percent: int):
    def assemble(table: pa.Table) -> pa.Table:
        """Of one chunk: its documents, each with its shared hashes, rarest first, and how many of them come first in its set."""
        head, parts = None, []
        for bucket, packed, df in zip(table["bucket"].to_pylist(), table["packed"], table["df"], strict=True):
            if bucket < 0:
                head = np.frombuffer(packed.as_py(), "<u8").reshape(-1, 5)
            else:
                keys, owners = unpack(packed.as_py())
                parts.append((owners, np.uint64(bucket) << np.uint64(64 - bits) | keys, np.frombuffer(df.as_py(), "<u4")))
        n = len(head)
        tokens = [None] * n
        first = np.zeros(n, np.int64)
        if parts:
            owner, token, df = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((token, df, owner))
            owner, token = owner[order], token[order]
            cut = np.searchsorted(owner, np.arange(n + 1, dtype=np.uint64))
            size = head[:, 2].astype(np.int64)
            shared = np.diff(cut)
            first = np.maximum(first_hashes(size, percent) - (size - shared), 0)
            for k in np.flatnonzero(first > 0):
                tokens[k] = token[cut[k] : cut[k + 1]].tobytes()
        return pa.table({
            "doc_id": pa.array(head[:, 0].astype("<u8").view("<i8"), pa.int64(), mask=head[:, 1] > 0),
            "n": pa.array(head[:, 2].astype(np.int64)),
            "name": pa.array([head[k, 3:].tobytes() for k in range(n)], pa.binary()),
            "first": pa.array(first, pa.int32()),
            "tokens": pa.array(tokens, pa.binary()),
        })

    return assemble


def linked(overlap: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Does an overlap of two sets, of so many elements in sum, make a link?"""
    return (100 + percent) * overlap >= percent * sizes


class SignatureTree:
    """Sets as leaves, in order of size; each level's nodes hold OR-combined bitmaps, size ranges and hash excess."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, bits: int):
        self.order = np.argsort(sizes, kind="stable")
        self.sets, self.sizes = sets, sizes
        maps = np.zeros((len(sets), bits // 8), np.uint8)
        for row, k in enumerate(self.order):
            place = (mix(sets[k]) % np.uint64(bits)).astype(np.int64)
            flags = np.zeros(bits, np.uint8)
            flags[place] = 1
            maps[row] = np.packbits(flags)
        low = sizes[self.order]
        words = maps.view("<u8")
        spare = np.array([len(sets[k]) for k in self.order]) - np.bitwise_count(words).sum(1, dtype=np.int64)
        self.levels = [(words, low, low, spare)]
        while len(self.levels[-1][0]) > 1:
            m, lo, hi, sp = self.levels[-1]
            cut = np.arange(0, len(m), FAN)
            self.levels.append((np.bitwise_or.reduceat(m, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(sp, cut)))


def _possible(a: tuple, b: tuple, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Which node pairs may hold a link: by size ranges and by the largest possible overlap."""
    fit = (100 * a[1][x] <= 10000 * b[2][y] // percent) & (100 * b[1][y] <= 10000 * a[2][x] // percent)
    x, y, out = x[fit], y[fit], fit
    most = np.bitwise_count(a[0][x] & b[0][y]).sum(1, dtype=np.int64) + np.minimum(a[3][x], b[3][y])
    out[np.flatnonzero(fit)] = linked(most, a[1][x] + b[1][y], percent)
    return out


def tree_links(left: list[np.ndarray], left_sizes: np.ndarray, right: list[np.ndarray] | None, right_sizes: np.ndarray | None, labels: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between the sets of two lists, or within one (``right`` is None), until they connect all that is linked.

    ``labels`` has a number for each set (those of ``right`` after those of ``left``); equal ones are already connected.
    """
    longest = max([len(s) for s in left] + [len(s) for s in right or []] + [16])
    bits = 1 << min(14, max(8, math.ceil(math.log2(4 * longest))))
    a = SignatureTree(left, left_sizes, bits)
    b = a if right is None else SignatureTree(right, right_sizes, bits)
    shift = 0 if right is None else len(left)
    parent = list(range(len(labels)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen: dict[int, int] = {}
    for i, label in enumerate(labels):
        parent[i] = seen.setdefault(int(label), i)
    found: list[tuple[int, int]] = []

    def count(x: np.ndarray, y: np.ndarray) -> None:
        """Exact overlaps of leaf pairs that aren't connected yet."""
        i, j = a.order[x], b.order[y]
        root = np.array([find(k) for k in range(len(parent))])
        apart = root[i] != root[j + shift]
        for p, q in zip(i[apart], j[apart], strict=True):
            u, v = find(int(p)), find(int(q) + shift)
            if u == v:
                continue
            other = (b.sets)[q]
            overlap = len(np.intersect1d(a.sets[p], other, assume_unique=True))
            if linked(overlap, a.sizes[p] + b.sizes[q], percent):
                parent[max(u, v)] = min(u, v)
                found.append((int(p), int(q) + shift))

    def descend(la: int, lb: int, x: np.ndarray, y: np.ndarray) -> None:
        """Node pairs (x at level la, y at level lb), depth first in slices."""
        for s in range(0, len(x), 4096):
            u, v = x[s : s + 4096], y[s : s + 4096]
            ok = _possible(a.levels[la], b.levels[lb], u, v, percent)
            u, v = u[ok], v[ok]
            if not len(u):
                continue
            if not la and not lb:
                count(u, v)
                continue
            if la >= lb:
                kids = np.minimum(FAN, len(a.levels[la - 1][0]) - u * FAN)
                nu = np.repeat(u * FAN, kids) + np.arange(kids.sum()) - np.repeat(np.cumsum(kids) - kids, kids)
                nv, na, nb = np.repeat(v, kids), la - 1, lb
            else:
                kids = np.minimum(FAN, len(b.levels[lb - 1][0]) - v * FAN)
                nv = np.repeat(v * FAN, kids) + np.arange(kids.sum()) - np.repeat(np.cumsum(kids) - kids, kids)
                nu, na, nb = np.repeat(u, kids), la, lb - 1
            if right is None and na == nb:
                half = nu < nv if na == 0 else nu <= nv
                nu, nv = nu[half], nv[half]
            descend(na, nb, nu, nv)

    descend(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))
    return found


def _tree_task(percent: int):
    def task(table: pa.Table) -> pa.Table:
        """Of one pair of blocks (or one block): links as pairs of names."""
        side = np.array(table["side"].to_pylist())
        names = table["name"].to_pylist()
        sizes = table["n"].to_numpy()
        sets = [np.sort(np.frombuffer(t.as_py(), "<u8")) for t in table["tokens"]]
        labels = {x: k for k, x in enumerate(dict.fromkeys(table["label"].to_pylist()))}
        label = np.array([labels[x] for x in table["label"].to_pylist()])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        order = np.concatenate([left, right])
        if not len(left) or (len(right) == 0 and len(left) < 2):
            found = []
        else:
            found = tree_links([sets[k] for k in left], sizes[left], [sets[k] for k in right] if len(right) else None, sizes[right], label[order], percent)
        return pa.table({"a": pa.array([names[order[p]] for p, _ in found], pa.binary()), "b": pa.array([names[order[q]] for _, q in found], pa.binary())})

    return task


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, owner: str = "query") -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each input row."""
    spark = docs.sparkSession
    bits = min(20, max(6, math.ceil(math.log2(int(spark.conf.get("spark.sql.shuffle.partitions")))) + 1))  # decides on the size of tasks only
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = steady(rows, owner)  # chunks are named by the place of their rows
    packed = rows.mapInArrow(tidy(_chunks(bits, words)), "chunk string, bucket int, packed binary")
    shared = packed.groupBy("bucket").applyInArrow(tidy(_shared(bits)), "chunk string, bucket int, packed binary, df binary")
    found = materialise(shared.groupBy("chunk").applyInArrow(tidy(_documents(bits, percent)), "doc_id long, n long, name binary, first int, tokens binary"), owner)

    sets = materialise(found.filter("first > 0").groupBy("name").agg(F.max("n").alias("n"), F.max("first").alias("first"), F.first("tokens", ignorenulls=True).alias("tokens")), owner)

    def explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                mine = [np.frombuffer(t.as_py(), "<i8")[:k] for t, k in zip(part.column(2), part.column(1).to_pylist(), strict=True)]
                index = pa.array(np.repeat(np.arange(len(mine)), [len(m) for m in mine]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(index), pa.array(np.concatenate(mine), pa.int64())], ["name", "token"])

    postings = materialise(sets.select("name", "first", "tokens").mapInArrow(tidy(explode), "name binary, token long"), owner)
    leads = postings.groupBy("token").agg(F.min("name").alias("lead"), F.max("name").alias("last")).filter("lead <> last").drop("last")
    shards = components(postings.join(leads, "token").select(F.col("name").alias("a"), F.col("lead").alias("b")), owner)

    counts = shards.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK))).cast("int").alias("blocks"))
    leaves = sets.join(shards.select(F.col("node").alias("name"), "root"), "name").join(counts, "root")
    leaves = materialise(leaves.select("root", "blocks", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int").alias("block"), "name", "n", "tokens"), owner)
    schema = "a binary, b binary"
    cols = ["root", "i", "j", "side", "name", "n", "tokens", "label"]
    own = leaves.withColumns({"i": F.col("block"), "j": F.col("block"), "side": F.lit(0), "label": F.col("name")}).select(*cols)
    split = leaves.filter("blocks > 1").withColumn("label", F.col("name"))
    with_first = split.filter("block > 0").withColumns({"i": F.lit(0), "j": F.col("block"), "side": F.lit(1)}).select(*cols)
    of_first = split.filter("block = 0").withColumns({"i": F.lit(0), "j": F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)), "side": F.lit(0)}).select(*cols)
    links = materialise(own.unionByName(with_first).unionByName(of_first).groupBy("root", "i", "j").applyInArrow(tidy(_tree_task(percent)), schema), owner)
    if not split.isEmpty():
        sofar = components(links, owner).select(F.col("node").alias("name"), F.col("root").alias("to"))
        split = split.join(sofar, "name", "left").withColumn("label", F.coalesce("to", "name")).drop("to")
        blocks = split.groupBy("root", "block").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("block > 0")
        pairs = blocks.alias("x").join(blocks.alias("y"), F.expr("x.root = y.root AND x.block < y.block AND NOT (x.least = x.most AND y.least = y.most AND x.least = y.least)"))
        pairs = materialise(pairs.select("x.root", F.col("x.block").alias("i"), F.col("y.block").alias("j")), owner)
        rest = pairs.select("root", "i", "j", F.col("i").alias("block"), F.lit(0).alias("side")).union(pairs.select("root", "i", "j", F.col("j").alias("block"), F.lit(1).alias("side")))
        more = rest.join(split, ["root", "block"]).select(*cols).groupBy("root", "i", "j").applyInArrow(tidy(_tree_task(percent)), schema)
        links = links.unionByName(materialise(more, owner))
    classes = components(links, owner).select(F.col("node").alias("name"), F.col("root").alias("to"))
    named = found.select("doc_id", "n", "name").join(classes, "name", "left").withColumn("component", F.coalesce("to", "name"))
    # written first, so that the join's own exchange can be split where one component holds much of the table
    least = materialise(named.filter("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id")), owner)
    return named.filter("n > 0").join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(
        found.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: str = "query") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, with all columns."""
    groups = near_groups(docs, id_col, text_col, owner=owner)
    stay = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct().alias("stay")
    return docs.alias("docs").join(stay, F.col(f"docs.{id_col}").cast("long").eqNullSafe(F.col("stay.doc_id")), "left_semi")
