"""Approximate nearest neighbours by robust-pruned directed graphs.

Equal vectors are one point with its smallest ids (k + 1 of them, all that a list of k can use). Points are dealt to bands of
nearly equal norm (a factor of ``RATIO``) and within a band to shards by hash. A shard's graph is built in steps of
points: a greedy search from the shard's medoid and points far apart proposes neighbours, relaxed distance pruning keeps those that no kept
one stands for, edges go both ways, and a full node is pruned again. A query is answered by a beam search in every shard's
graph; the shards' lists are merged. Distances are Euclidean on vectors lengthened by one coordinate that makes all norms
of a shard equal, which turns the largest inner product into the nearest point; within a band that coordinate is small, so
short vectors do not crowd together. Scores are recomputed in double precision on the original vectors.

Shards hold about ``SHARD`` points, so a graph's build is bounded; their number grows with the table. Norms with fewer than
``BAND`` points share a band with their neighbours. A shard travels as one row with its graph, queries in blocks of
``QUERIES``: the stated query set meets every shard, block by block, so the work is queries times shards.

Defined results: null ids take no part, nor do vectors that are null, empty, zero, or hold null or non-finite components;
only vectors of one length are compared; fewer candidates than k give all of them; ties go to smaller ids; repeated ids are
candidates like others but a query's own id never is, and a repeated query is answered once for each different vector; sums
that overflow come last; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise

K, SHARD, QUERIES, LANE = 20, 3000, 256, 16
#: Norms of a band differ by this factor; a band of its own needs so many points.
RATIO, BAND = 1.1, 64
#: Most edges of a node, width of the beam in build and search, relaxation of the pruning.
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 24, 40, 64, 1.2
#: Most entry nodes of a graph.
ENTRIES = 48
#: Points that are searched or pruned together.
STEP = 256


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def layer(vector: Column) -> Column:
    """Number of the norm's power of ``RATIO``, without overflow."""
    most = F.array_max(F.transform(vector, lambda x: F.abs(x)))
    # a lambda over an array of one binds the largest component, which would be taken anew for each component else
    square = lambda m: F.aggregate(vector, F.lit(0.0), lambda total, x: total + (x / m) * (x / m))
    return F.transform(F.array(most), lambda m: F.floor((F.log(m) + F.log(square(m)) / 2) / math.log(RATIO) + 0.5).cast("int"))[0]


def lengthened(vectors: np.ndarray) -> np.ndarray:
    """Points with one more coordinate, by which all have the norm of the longest, scaled to norm 1."""
    scaled = vectors / np.abs(vectors).max()
    squares = np.einsum("ij,ij->i", scaled, scaled)
    longest = squares.max()
    return (np.concatenate([scaled, np.sqrt(np.maximum(longest - squares, 0))[:, None]], axis=1) / np.sqrt(longest)).astype(np.float32)


def beam_search(points: np.ndarray, edges: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances, nodes) of each query, nearest first, padded by (inf, -1): the beam's end state and all nodes it expanded.

    The queries walk in step: each expands its nearest unexpanded node until its beam has none. Distances lack the query's
    own square, which no order depends on.
    """
    n, count = len(points), len(queries)
    square = np.einsum("ij,ij->i", points, points)
    first = square[starts] - 2 * (queries @ points[starts].T)
    order = np.argsort(first, axis=1, kind="stable")
    pad = ((0, 0), (0, max(beam - len(starts), 0)))
    dist = np.pad(np.take_along_axis(first, order, 1), pad, constant_values=np.inf)[:, :beam].astype(np.float32)
    node = np.pad(starts[order].astype(np.int64), pad, constant_values=-1)[:, :beam]
    done = node < 0
    seen = np.zeros((count, n), bool)
    seen[:, starts] = True
    ends: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = np.arange(count)
    while len(rows):
        at = (~done[rows]).argmax(1)
        going = ~done[rows, at]
        rows, at = rows[going], at[going]
        if not len(rows):
            break
        own = node[rows, at]
        done[rows, at] = True
        ends.append((rows, own, dist[rows, at]))
        near = edges[own].astype(np.int64)
        new = (near >= 0) & ~seen[rows[:, None], near]
        near = np.where(new, near, 0)
        d = square[near] - 2 * np.matmul(points[near], queries[rows][:, :, None])[:, :, 0]
        d = np.where(new, d, np.inf)
        r, c = np.nonzero(new)
        seen[rows[r], near[r, c]] = True
        d = np.concatenate([dist[rows], d], axis=1)
        order = np.argsort(d, axis=1, kind="stable")[:, :beam]
        dist[rows] = np.take_along_axis(d, order, 1)
        node[rows] = np.take_along_axis(np.concatenate([node[rows], np.where(new, near, -1)], axis=1), order, 1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], ~new], axis=1), order, 1)
    # expanded nodes that later ones pushed out of the beam
    who, what, far = (np.concatenate(x) for x in zip(*ends, strict=True))
    out = ~(node[who] == what[:, None]).any(1)
    who, what, far = who[out], what[out], far[out]
    order = np.argsort(who, kind="stable")
    who, what, far = who[order], what[order], far[order]
    place = np.arange(len(who)) - np.searchsorted(who, who)
    width = int(place.max()) + 1 if len(place) else 0
    more, more_dist = np.full((count, width), -1, np.int64), np.full((count, width), np.inf, np.float32)
    more[who, place], more_dist[who, place] = what, far
    dist, node = np.concatenate([dist, more_dist], axis=1), np.concatenate([node, more], axis=1)
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(dist, order, 1), np.take_along_axis(node, order, 1)


def robust_prune(points: np.ndarray, nodes: np.ndarray, near: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Of each node's proposed neighbours (padded by -1) those that no kept one is nearer to by the factor alpha, nearest first."""
    near = np.where(near == nodes[:, None], -1, near)
    some = points[near]
    diff = some - points[nodes][:, None, :]
    dist = np.where(near >= 0, np.einsum("bij,bij->bi", diff, diff), np.inf)
    order = np.argsort(dist, axis=1, kind="stable")[:, : 4 * degree]
    near, dist, some = np.take_along_axis(near, order, 1), np.take_along_axis(dist, order, 1), np.take_along_axis(some, order[:, :, None], 1)
    norm = np.einsum("bij,bij->bi", some, some)
    between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(some, some.transpose(0, 2, 1))
    alive = near >= 0
    kept = np.full((len(nodes), degree), -1, np.int32)
    size = np.zeros(len(nodes), np.int64)
    for i in range(near.shape[1]):
        take = np.flatnonzero(alive[:, i] & (size < degree))
        if not len(take):
            continue
        kept[take, size[take]] = near[take, i]
        size[take] += 1
        alive[take] &= alpha * alpha * between[take, i] > dist[take]
    return kept


def entries(points: np.ndarray) -> np.ndarray:
    """Entry nodes: the medoid, then each time the point farthest from those taken, so that separate clusters all have one."""
    centre = points.mean(0)
    taken = [int(((points - centre) ** 2).sum(1).argmin())]
    far = ((points - points[taken[0]]) ** 2).sum(1)
    while len(taken) < ENTRIES and far.max() > 0:
        taken.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[taken[-1]]) ** 2).sum(1))
    return np.array(taken, np.int32)


def build(points: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Edges (n x DEGREE, padded by -1) and the entry nodes."""
    n = len(points)
    rng = np.random.default_rng(seed)
    starts = entries(points)
    edges = np.full((n, DEGREE), -1, np.int32)
    if n <= 1:
        return edges, starts
    # a few random edges, so that the first searches get anywhere
    first = rng.integers(0, n - 1, (n, min(4, n - 1)))
    first = np.sort(first + (first >= np.arange(n)[:, None]), axis=1)
    first[:, 1:][first[:, 1:] == first[:, :-1]] = -1
    edges[:, : first.shape[1]] = first
    turn = rng.permutation(n)
    for low in range(0, n, STEP):
        some = turn[low : low + STEP]
        _, near = beam_search(points, edges, starts, points[some], BUILD_BEAM)
        near = np.concatenate([near, np.where((edges[some][:, :, None] == near[:, None, :]).any(2), -1, edges[some])], axis=1)
        edges[some] = robust_prune(points, some, near, ALPHA, DEGREE)
        # the same edges backwards; a node that would have too many is pruned
        ends, begin = edges[some].ravel(), np.repeat(some, DEGREE)
        begin, ends = begin[ends >= 0], ends[ends >= 0]
        fresh = ~(edges[ends] == begin[:, None]).any(1)
        order = np.argsort(ends[fresh], kind="stable")
        begin, ends = begin[fresh][order], ends[fresh][order]
        place = np.arange(len(ends)) - np.searchsorted(ends, ends)
        target, row = np.unique(ends, return_inverse=True)
        # in rounds of DEGREE new edges a node, so that a much wanted node is no larger piece of work
        for r in range(int(place.max()) // DEGREE + 1 if len(place) else 0):
            mine = place // DEGREE == r
            extra = np.full((len(target), DEGREE), -1, np.int32)
            extra[row[mine], place[mine] % DEGREE] = begin[mine]
            touched = np.flatnonzero((extra >= 0).any(1))
            for part in range(0, len(touched), STEP):
                at = touched[part : part + STEP]
                both = np.concatenate([edges[target[at]], extra[at]], axis=1)
                full = (both >= 0).sum(1) > DEGREE
                if full.any():
                    edges[target[at[full]]] = robust_prune(points, target[at[full]], both[full], ALPHA, DEGREE)
                room = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :DEGREE]
                edges[target[at[~full]]] = room[~full]
    return edges, starts


def _matrix(table: pa.Table) -> np.ndarray:
    return pc.list_flatten(table["vector"]).to_numpy().astype(np.float64).reshape(table.num_rows, -1)


def _index(table: pa.Table) -> pa.Table:
    """Of one shard: its vectors, their ids and the graph."""
    vectors = _matrix(table)
    edges, starts = build(lengthened(vectors))
    return pa.table({
        "dim": pa.array([vectors.shape[1]], pa.int32()),
        "shard": pa.array([table["shard"][0].as_py()], pa.int64()),
        "vectors": pa.array([vectors.tobytes()], pa.binary()),
        "edges": pa.array([edges.tobytes()], pa.binary()),
        "starts": pa.array([starts.tobytes()], pa.binary()),
        "ids": pa.array([pc.list_flatten(table["ids"]).to_numpy().astype("<i8").tobytes()], pa.binary()),
        "counts": pa.array([pc.list_value_length(table["ids"]).to_numpy().astype("<i4").tobytes()], pa.binary()),
    })


def _search(k: int, beam: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard columns, a block of queries): the k nearest of each query in the shard."""
        last, graph = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                dim = row["dim"]
                if last != row["vectors"]:
                    vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
                    ids = np.frombuffer(row["ids"], "<i8")
                    ends = np.concatenate([[0], np.cumsum(np.frombuffer(row["counts"], "<i4"))])
                    graph = (lengthened(vectors), np.frombuffer(row["edges"], np.int32).reshape(-1, DEGREE))
                    last = row["vectors"]
                points, edges = graph
                queries, which = np.unique(np.frombuffer(row["queries"], np.float64).reshape(-1, dim), axis=0, return_inverse=True)
                # scaled to the points' norm: nearness to a direction is the same order
                long = queries / np.abs(queries).max(1)[:, None]
                long = np.concatenate([long / np.sqrt((long**2).sum(1))[:, None], np.zeros((len(long), 1))], axis=1).astype(np.float32)
                _, nodes = beam_search(points, edges, np.frombuffer(row["starts"], np.int32), long, max(beam, 2 * k + 10))
                own_id, found_id, scores = [], [], []
                for own, q in zip(np.frombuffer(row["query_ids"], "<i8"), which.ravel(), strict=True):
                    near = nodes[q][: 2 * k + 10]
                    near = near[near >= 0]
                    with np.errstate(all="ignore"):
                        score = np.einsum("ij,j->i", vectors[near], queries[q])
                    size = ends[near + 1] - ends[near]
                    mine = np.repeat(ends[near], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    found, score = ids[mine], np.repeat(score, size)
                    keep = found != own
                    found, score = found[keep], score[keep]
                    order = np.lexsort((found, -score))[:k]
                    own_id.append(np.full(len(order), own))
                    found_id.append(found[order])
                    scores.append(score[order])
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.concatenate(own_id)), "vec_id": pa.array(np.concatenate(found_id)), "score": pa.array(np.concatenate(scores))})

    return run


def _blocks(table: pa.Table) -> pa.Table:
    vectors = _matrix(table)
    return pa.table({"dim": pa.array([vectors.shape[1]], pa.int32()), "block": pa.array([table["block"][0].as_py()], pa.int64()), "queries": pa.array([vectors.tobytes()], pa.binary()), "query_ids": pa.array([table["vec_id"].to_numpy().astype("<i8").tobytes()], pa.binary())})


def _few(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """A written table, to be broadcast if its size, which is looked up, is small; else Spark chooses the join."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def _bands(points: DataFrame, owner: str) -> DataFrame:
    """dim, layer, first, shards: the shards (numbered through in a dim) of each layer's band. Doubles have 15,000 layers at most."""
    layers = points.groupBy("dim", "layer").agg(F.count(F.lit(1)).alias("n")).withColumn("large", F.col("n") >= BAND)
    down = Window.partitionBy("dim").orderBy(F.col("layer").desc())
    layers = layers.withColumn("run", F.sum(F.col("large").cast("int")).over(down))
    small = Window.partitionBy("dim", "large", "run").orderBy(F.col("layer").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = F.when(F.col("large"), 0).otherwise(F.coalesce(F.sum("n").over(small), F.lit(0)))
    layers = layers.withColumn("part", F.floor(before / BAND))
    bands = layers.groupBy("dim", "large", "run", "part").agg(F.ceil(F.sum("n") / F.lit(float(SHARD))).alias("shards"))
    through = Window.partitionBy("dim").orderBy("run", "large", "part").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.withColumn("first", F.coalesce(F.sum("shards").over(through), F.lit(0)))
    return materialise(layers.join(bands, ["dim", "large", "run", "part"]).select("dim", "layer", "first", "shards"), owner)


def nearest(table: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = SEARCH_BEAM, owner: str = "query") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row, among all other rows."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("query"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    some = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    points = rows.select("vector", "vec_id").distinct().withColumn("n", some).filter(F.col("n") <= k + 1).groupBy("vector").agg(F.collect_list("vec_id").alias("ids"))
    points = materialise(points.select("vector", "ids", F.size("vector").alias("dim"), layer(F.col("vector")).alias("layer"), F.xxhash64("vector").alias("h")), owner)
    bands = _bands(points, owner)
    sizes = _few(bands.groupBy("dim").agg(F.max(F.col("first") + F.col("shards")).cast("long").alias("shards")))  # one row for each length of vectors
    dealt = points.join(_few(bands), ["dim", "layer"]).withColumn("shard", F.col("first") + F.pmod("h", "shards"))
    index = materialise(dealt.groupBy("dim", "shard").applyInArrow(lambda t: _index(t), "dim int, shard long, vectors binary, edges binary, starts binary, ids binary, counts binary"), owner)
    asked = rows.filter("query").select("vec_id", "vector", F.size("vector").alias("dim")).distinct()
    counts = asked.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(QUERIES))).cast("int").alias("blocks"))
    counts = _few(materialise(counts, owner))
    queries = asked.join(counts, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    queries = materialise(queries.groupBy("dim", "block").applyInArrow(lambda t: _blocks(t), "dim int, block long, queries binary, query_ids binary"), owner)
    # a task takes one shard and a lane of query blocks: shards go to every lane, blocks to every shard
    lanes = index.join(counts, "dim").withColumn("lane", F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / LANE).cast("int")))).drop("blocks")
    asked_of = queries.join(sizes, "dim").select("dim", F.floor(F.col("block") / LANE).cast("int").alias("lane"), "queries", "query_ids", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    pairs = lanes.join(asked_of.hint("shuffle_merge"), ["dim", "shard", "lane"])
    found = pairs.select("dim", "vectors", "edges", "starts", "ids", "counts", "queries", "query_ids").mapInArrow(_search(k, beam), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.when(~F.isnan("score"), F.col("score")).desc_nulls_last(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
