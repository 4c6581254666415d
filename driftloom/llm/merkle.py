"""Merkle manifest of a dataset: one root for all rows, and for each row a proof that ties it to the root.

Every row is a leaf. Within a group (a language) leaves ascend by id and every eight consecutive nodes become one, until one is left,
the group's root; the groups' roots, in order, make the dataset's root the same way.

1. Leaves. Column expressions hash each row; only (group, id, digest, digest as presented) goes on, 80 bytes or so.
2. Order. A range partitioning by group, id and digest gives each partition a run of the order; its place in the group is its
   place in the partition plus the sizes of the partitions before, one small row for each partition and group.
3. Blocks of 8**3 aligned leaves. One task packs and traverses a block: a postorder recursion returns a subtree's digest and,
   while it unwinds, appends the siblings of each child to the paths of the leaves below it. All blocks of a group but the last have
   full height, so block roots are nodes of the tree: they feed the next distributed traversal, until each group has one node.
4. Ways down. The paths of the few upper nodes are extended tier by tier; each block is then traversed again with the path
   above it, which completes proofs, and folds each leaf's path to the root it leads to.

No group, however large, is one task's work: a task holds one block. Nothing is collected on the driver.

Defined results: a null value hashes as ``-`` in its leaf; leaves with equal ids are ordered by digest, null ids come first; equal rows are
leaves of their own next to each other; a very long text is hashed by one
expression; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise
from .textarrays import tidy

#: Nodes of a run, and levels of a block.
FAN, LEVELS = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One level of a path: a run has ``FAN`` nodes at most, so a place and a count fit a byte each.
Path = list[tuple[int, list[bytes]]]


def digest(parts: Sequence[bytes]) -> bytes:
    """H of digests, which count as lowercase hex text."""
    return hashlib.sha256(b"".join(parts).hex().encode()).digest()


def traverse(leaves: list[bytes], levels: int | None = None, below: list[Path] | None = None) -> bytes:
    """The root of ``leaves`` at height ``levels`` (None: the least at which one node is left).

    ``below`` has a path for each leaf: (place in the run, the run's other nodes) is appended for every level while unwinding.
    """
    if levels is None:
        levels = 0
        while FAN**levels < len(leaves):
            levels += 1

    def visit(height: int, lo: int, hi: int) -> bytes:
        if not height:
            return leaves[lo]
        step = FAN ** (height - 1)
        starts = range(lo, hi, step)
        kids = [visit(height - 1, a, min(a + step, hi)) for a in starts]
        if below is not None:
            for k, a in enumerate(starts):
                entry = (k, kids[:k] + kids[k + 1 :])
                for leaf in range(a, min(a + step, hi)):
                    below[leaf].append(entry)
        return digest(kids)

    return visit(levels, 0, len(leaves))


def pack(path: Path) -> bytes:
    return b"".join(bytes([k, len(others)]) + b"".join(others) for k, others in path)


def unpack(raw: bytes) -> Path:
    out, i = [], 0
    while i < len(raw):
        k, n = raw[i], raw[i + 1]
        out.append((k, [raw[j : j + 32] for j in range(i + 2, i + 2 + 32 * n, 32)]))
        i += 2 + 32 * n
    return out


def fold(leaf: bytes, path: Path) -> bytes:
    """The root that a leaf and its path lead to."""
    for k, others in path:
        leaf = digest([*others[:k], leaf, *others[k:]])
    return leaf


def proof_digest(path: Path) -> str:
    """H of all siblings, from the leaf's level up, each level left to right."""
    return digest([x for _, others in path for x in others]).hex()


def leaf_digest(fields: Sequence[Column]) -> Column:
    """H of a row: each field's length in bytes, a colon and its value, or ``-`` if it is null."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (f.cast("string") for f in fields)]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _numbered(rows: DataFrame, group: str, order: Sequence[str], owner: str) -> DataFrame:
    """``rows`` with place (from 0, in their group by ``order``) and total (rows of the group), written."""
    cols = rows.columns
    at = cols.index(group)

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            keys = batch.column(at)
            codes = keys.dictionary_encode()
            codes = codes.indices.to_numpy(zero_copy_only=False)
            head = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
            place = np.arange(len(codes)) - np.repeat(head, np.diff(np.append(head, len(codes))))
            if len(codes):
                if keys[0].as_py() == last:
                    place[: head[1] if len(head) > 1 else len(codes)] += seen
                last, seen = keys[-1].as_py(), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(codes), part), pa.int32()), pa.array(place, pa.int64())], [*cols, "part", "inner"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    # written: a task that runs again must find the same ranges
    ranged = materialise(ranged.mapInArrow(tidy(number), f"{schema}, part int, inner long"), owner)
    sizes = ranged.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(group).orderBy("part")
    # a row for each partition and group
    sizes = sizes.select(group, "part", (F.sum("n").over(before) - F.col("n")).alias("base"), F.sum("n").over(Window.partitionBy(group)).alias("total"))
    return ranged.join(sizes, [group, "part"]).select(*cols, (F.col("base") + F.col("inner")).alias("place"), "total")


def _block(levels: int):
    def task(key: tuple, table: pa.Table) -> pa.Table:
        """One aligned block: its nodes in order, packed, what they carry, and its root (at full height unless it is all of its group)."""
        table = table.sort_by("place")
        nodes, total = table["node"].to_pylist(), table["total"][0].as_py()
        alone = total <= FAN**levels
        return pa.table({
            "grp": pa.array([key[0].as_py()], pa.string()), "block": pa.array([key[1].as_py()], pa.int64()),
            "blocks": pa.array([-(-total // FAN**levels)], pa.int64()), "alone": pa.array([alone]),
            "nodes": pa.array([b"".join(nodes)], pa.binary()), "load": pa.array([table["load"].to_pylist()], pa.list_(pa.binary())),
            "top": pa.array([traverse(nodes, None if alone else levels)], pa.binary()),
        })

    return task


def _blocks(placed: DataFrame, levels: int, owner: str) -> DataFrame:
    """(grp, place, total, node, load) to one row for each aligned block, written."""
    placed = placed.withColumn("block", F.floor(F.col("place") / F.lit(FAN**levels)).cast("long"))
    schema = "grp string, block long, blocks long, alone boolean, nodes binary, load array<binary>, top binary"
    return materialise(placed.groupBy("grp", "block").applyInArrow(tidy(_block(levels)), schema), owner)


def forest(rows: DataFrame, order: Sequence[str], levels: int = LEVELS, owner: str = "query") -> tuple[list[DataFrame], DataFrame]:
    """Trees of all groups at once: from (grp, node, load, and the columns of ``order``) to the blocks of every tier and (grp, top)."""
    tiers = [_blocks(_numbered(rows, "grp", order, owner), levels, owner)]
    while not (open_ := tiers[-1].filter(~F.col("alone"))).isEmpty():
        tiers.append(_blocks(open_.select("grp", F.col("block").alias("place"), F.col("blocks").alias("total"), F.col("top").alias("node"), F.lit(None).cast("binary").alias("load")), levels, owner))
    tops = [tier.filter("alone").select("grp", "top") for tier in tiers]
    return tiers, materialise(functools.reduce(DataFrame.union, tops), owner)


def _paths(nodes: bytes, alone: bool, levels: int) -> list[Path]:
    leaves = [nodes[i : i + 32] for i in range(0, len(nodes), 32)]
    below: list[Path] = [[] for _ in leaves]
    traverse(leaves, None if alone else levels, below)
    return below


def _down(levels: int):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a tier and the path above each, to the path above each of their nodes."""
        for batch in batches:
            for grp, block, alone, nodes, load, above in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                paths = _paths(nodes, alone, levels)
                yield pa.RecordBatch.from_pydict({
                    "grp": pa.array([grp] * len(paths), pa.string()),
                    "place": pa.array([block * FAN**levels + k for k in range(len(paths))], pa.int64()),
                    "load": pa.array(load, pa.binary()),
                    "above": pa.array([pack(p) + above for p in paths], pa.binary()),
                })

    return scan


_BLOCK_COLS = ("grp", "block", "alone", "nodes", "load", "above")


def _ways(tiers: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """Blocks of the lowest tier with the path above each; ``tops`` has the path above each group's root (grp, above)."""
    above: DataFrame | None = None
    for tier in reversed(tiers):
        known = tier.filter("alone").join(tops, "grp").select(*_BLOCK_COLS)
        if above is not None:
            down = above.mapInArrow(tidy(_down(levels)), "grp string, place long, load binary, above binary")
            known = known.union(tier.filter("not alone").join(down.select("grp", F.col("place").alias("block"), "above"), ["grp", "block"]).select(*_BLOCK_COLS))
        above = known
    return above


def _proofs(levels: int):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lowest blocks with the path above them, to a row for each leaf: its proof, and the root that it folds to."""
        for batch in batches:
            for alone, nodes, load, above, subroot, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rest, out = unpack(above), []
                for k, path in enumerate(_paths(nodes, alone, levels)):
                    leaf, known, path = nodes[32 * k : 32 * k + 32], load[k], [*path, *rest]
                    doc_id = int.from_bytes(known[1:9], "big", signed=True) if known[0] else None
                    folded = fold(known[9:] or leaf, path)
                    out.append((doc_id, leaf.hex(), subroot.hex(), root.hex(), proof_digest(path), folded.hex(), folded == root))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _TYPES, strict=True)], list(_NAMES))

    return scan


_NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
_TYPES = (pa.int64(), *[pa.string()] * 5, pa.bool_())


def manifest(docs: DataFrame, presented: dict[str, Column] | None = None, where: Column | None = None, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", levels: int = LEVELS, owner: str = "query") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row for each row of ``docs``.

    ``presented`` holds other values of some fields, as a reader was given them in the rows ``where`` says (all, if None): the leaf of such a row
    is folded from them along the original siblings, and ``verified`` tells whether the original root comes out.
    """
    cols = {c: F.col(f"`{c}`") for c in fields}
    other = F.lit(None).cast("binary")
    if presented:
        other = leaf_digest(list((cols | presented).values()))
        other = F.when(where, other) if where is not None else other
    doc_id = F.col(f"`{id_col}`").cast("long")
    group = F.col(f"`{group_col}`").cast("string")
    # a flag, the id's eight bytes, the other leaf if there is one
    load = F.concat(F.when(doc_id.isNull(), F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("01"))), F.unhex(F.lpad(F.hex(F.coalesce(doc_id, F.lit(0))), 16, "0")), F.coalesce(other, F.unhex(F.lit(""))))
    # a name that sorts as the group does: null before all others
    rows = docs.select(F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("grp"), doc_id.alias("doc_id"), leaf_digest(list(cols.values())).alias("node"), load.alias("load"))
    tiers, subroots = forest(materialise(rows, owner), ["doc_id", "node"], levels, owner)
    upper, root = forest(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("top").alias("node"), F.encode("grp", "utf-8").alias("load")), ["name"], levels, owner)
    root = root.select(F.col("top").alias("root"))
    ends = _ways(upper, upper[0].select("grp").distinct().withColumn("above", F.unhex(F.lit(""))), levels)
    ends = ends.mapInArrow(tidy(_down(levels)), "grp string, place long, load binary, above binary").select(F.decode("load", "utf-8").alias("grp"), "above")
    ends = materialise(ends.join(subroots.withColumnRenamed("top", "subroot"), "grp").join(F.broadcast(root)), owner)  # a row for each group; the root is one row
    lowest = _ways(tiers, ends.select("grp", "above"), levels).join(ends.select("grp", "subroot", "root"), "grp")
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return lowest.select("alone", "nodes", "load", "above", "subroot", "root").mapInArrow(tidy(_proofs(levels)), schema)


def lower_ascii(text: Column) -> Column:
    """A-Z of ``text`` lower-cased, all other characters kept."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered(doc_id: Column) -> Column:
    """Rows that the query tampers with: 3 divides the CRC-32 of the decimal id; never those without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 0, F.lit(False))
