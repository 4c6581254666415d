"""Removal of repeated passages by suffix arrays.

Every byte that a ``LENGTH``-byte string covers goes if that string also starts in a document with a smaller id. Matches
are of bytes, never cross documents, may overlap, and are judged on the input.

1. Every window of ``LENGTH`` bytes belongs to the smallest hash among its ``GRAM``-byte grams (scrambled, since smallest
   hashes are small and would share their leading bits), which is the same wherever the window occurs; neighbouring windows with one such anchor make a run. Chunks of texts send the hashes of their
   runs, packed, to buckets by leading bits; a bucket tells each chunk which of them other chunks have too. Whole texts
   are compared the same way, so of exact copies only the one with the smallest id goes on.
2. Runs whose anchor occurs in another document send their bytes to buckets; a chunk sends equal runs once, for the smallest
   id, and settles the others itself. So a passage that a third of all documents hold arrives once for each chunk.
3. A bucket builds the suffix array of its distinct runs by bucket-pointer refinement: suffixes are put into buckets by
   their first q bytes; a bucket of several is refined by the bucket numbers that the suffixes q bytes on have, which
   doubles the depth compared, the refined numbers being used in the next step. At depth ``LENGTH`` a bucket holds
   equal windows, and its smallest id decides for all of them.
4. Each chunk takes its removed windows and cuts them from its texts.

A window that occurs anywhere else has the same anchor there, so the result is exact. Defined results: null counts
as empty; texts of under ``LENGTH`` bytes lose nothing; a null doc_id is larger than all others; rows with one doc_id don't
remove from each other; a very long text is cut into runs by its anchors but its bytes are held by one task; repeated rows with different ids lose
what a smaller id holds; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import array
import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import steady
from .textarrays import _power, byte_table, mix, runs, tidy, utf8

LENGTH, GRAM = 50, 24
CHUNK = 1 << 20
#: Bytes of a bucket whose suffix array is built at once (more only if one anchor's runs need it).
ARRAY = 1 << 20
#: Bytes of text for each bucket; a bucket of shared runs has about as many, if most runs are shared.
BUCKET = 1 << 25
_AGAIN = np.uint64(0x9E3779B97F4A7C15)
_TABLE = byte_table(lower=False, seed=50)
_LAST = np.iinfo(np.int64).max
_RUN = np.dtype([("row", "<u4"), ("start", "<u4"), ("size", "<u4"), ("doc_id", "<i8"), ("anchor", "<u8")])
_CUT = np.dtype([("row", "<u4"), ("start", "<u4"), ("end", "<u4")])
_COPY = np.dtype([("h", "<u8"), ("g", "<u8"), ("doc_id", "<i8"), ("row", "<u4"), ("size", "<u4")])


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: row, first window, number of windows (places in ``data``), and the anchor's hash."""
    n, wide = len(data), LENGTH - GRAM + 1
    out: list[tuple] = []
    for s in range(0, n, CHUNK):
        part = data[s : s + CHUNK + LENGTH - 1]
        k = len(part)
        if k < LENGTH:
            break
        power, inverse = _power(CHUNK + LENGTH)
        sums = np.zeros(k + 1, np.uint64)
        np.cumsum(_TABLE[part] * power[:k], out=sums[1:])
        h = mix((sums[GRAM:] - sums[: k - GRAM + 1]) * inverse[: k - GRAM + 1])
        span = 1
        while span * 2 <= wide:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        if span < wide:
            h = np.minimum(h[: len(h) - (wide - span)], h[wide - span :])
        # h[p]: the anchor of the window at p; only windows within a row count
        i, j = int(np.searchsorted(at, s, side="right")) - 1, int(np.searchsorted(at, s + len(h), side="left"))
        edges = np.clip(at[i : j + 1] - s, 0, len(h))
        valid = np.ones(len(h), bool)
        for e in at[i + 1 : j + 1] - s:
            valid[max(e - LENGTH + 1, 0) : e] = False
        place = np.flatnonzero(valid)
        if not len(place):
            continue
        a, r = h[place], np.repeat(np.arange(i, j), np.diff(edges))[place]
        head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (r[1:] != r[:-1]) | (place[1:] != place[:-1] + 1)]))
        # the smallest of many hashes is small: scrambled again, so that leading bits deal anchors evenly
        out.append((r[head], place[head] + s, np.diff(np.append(head, len(place))), mix(a[head] + _AGAIN)))
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _named_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of a task: a name that a second run of the task gives again, bytes, row starts, ids and which ids are null."""
    task, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        data, at = utf8(batch.column(1))
        ids = batch.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False).astype("<i8")
        null = ~np.asarray(batch.column(0).is_valid())
        for i, j in runs(at, CHUNK):
            yield f"{task}/{made}", data[at[i] : at[j]], at[i : j + 1] - at[i], ids[i:j], null[i:j]
            made += 1


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for name, data, at, ids, null in _named_chunks(batches):
        yield pa.RecordBatch.from_pydict({"chunk": [name], "bytes": pa.array([data.tobytes()], pa.binary()), "starts": pa.array([at.astype("<i8").tobytes()], pa.binary()), "ids": pa.array([ids.tobytes()], pa.binary()), "nulls": pa.array([null.tobytes()], pa.binary())})


def _split(keys: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Rows by bucket; ``keys`` are sorted."""
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
    for a, e in zip(cut, [*cut[1:], len(keys)][: len(cut)], strict=True):
        yield int(keys[a]), rows[a:e].tobytes()


def _hashes(bits: int):
    """Texts to rows (chunk, kind, bucket, packed): kind 0 anchors' hashes, kind 1 whole texts'."""
    shift = np.uint64(64 - bits)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, data, at, ids, _ in _named_chunks(batches):
            kinds, buckets, packed = [], [], []
            a = np.unique(anchors(data, at)[3])
            low = ((a << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
            for bucket, raw in _split((a >> shift).astype(np.int64), low):
                kinds.append(0)
                buckets.append(bucket)
                packed.append(raw)
            size = np.diff(at)
            copy = np.zeros(int((size >= LENGTH).sum()), _COPY)
            for k, row in enumerate(np.flatnonzero(size >= LENGTH)):
                digest = hashlib.blake2b(data[at[row] : at[row + 1]], digest_size=16).digest()
                copy[k] = (int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little"), ids[row], row, size[row])
            copy = copy[np.argsort(copy["h"], kind="stable")]
            for bucket, raw in _split((copy["h"] >> shift).astype(np.int64), copy):
                kinds.append(1)
                buckets.append(bucket)
                packed.append(raw)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([name] * len(kinds), pa.string()), "kind": pa.array(kinds, pa.int32()), "bucket": pa.array(buckets, pa.int32()), "packed": pa.array(packed, pa.binary())})

    return scan


def _answers(table: pa.Table) -> pa.Table:
    """Of one bucket: to each chunk the anchors that other chunks have (kind 0), or its rows that copy a smaller id's text (kind 1)."""
    kind, chunks, out = table["kind"][0].as_py(), [], []
    blobs = [np.frombuffer(x.as_py(), "<u4" if kind == 0 else _COPY) for x in table["packed"]]
    values = np.concatenate(blobs)
    ends = np.concatenate([[0], np.cumsum([len(b) for b in blobs])])
    if kind == 0:
        _, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
        keep = count[inverse] > 1
    else:
        order = np.lexsort((values["doc_id"], values["g"], values["h"]))
        v = values[order]
        head = np.flatnonzero(np.concatenate([[True], (v["h"][1:] != v["h"][:-1]) | (v["g"][1:] != v["g"][:-1])]))
        least = np.repeat(v["doc_id"][head], np.diff(np.append(head, len(v))))
        keep = np.zeros(len(v), bool)
        keep[order] = v["doc_id"] > least
    for k in range(len(blobs)):
        mine = keep[ends[k] : ends[k + 1]]
        if mine.any():
            chunks.append(table["chunk"][k].as_py())
            out.append(blobs[k][mine].tobytes() if kind == 0 else blobs[k]["row"][mine].tobytes())
    n = len(chunks)
    return pa.table({"chunk": pa.array(chunks, pa.string()), "kind": pa.array([kind] * n, pa.int32()), "bucket": pa.array([table["bucket"][0].as_py()] * n, pa.int32()), "packed": pa.array(out, pa.binary())})


def _text_of(table: pa.Table, others: pa.Table) -> tuple[np.ndarray, ...] | None:
    if not table.num_rows:
        raise RuntimeError("the input gave other chunks when it was read again; write it to a table first")
    row = {c: table[c][0].as_py() for c in ("bytes", "starts", "ids", "nulls")}
    return np.frombuffer(row["bytes"], np.uint8), np.frombuffer(row["starts"], "<i8"), np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["nulls"], bool)


_RUNS = "bucket int, chunk string, bytes binary, meta binary"


def _shared_runs(bits: int):
    shift = np.uint64(64 - bits)

    def task(text: pa.Table, answers: pa.Table) -> pa.Table:
        """Of one chunk: its shared runs by bucket; below bucket 0, cuts that are already known."""
        data, at, ids, _ = _text_of(text, answers)
        name = text["chunk"][0].as_py()
        shared, copies = [], np.zeros(0, np.int64)
        for kind, bucket, packed in zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["packed"], strict=True):
            if kind == 0:
                shared.append(np.uint64(bucket) << np.uint64(32) | np.frombuffer(packed.as_py(), "<u4").astype(np.uint64))
            else:
                copies = np.concatenate([copies, np.frombuffer(packed.as_py(), "<u4")])
        cuts = [(int(r), 0, int(at[r + 1] - at[r])) for r in copies]
        row, start, count, anchor = anchors(data, at)
        alone = np.ones(len(at) - 1, bool)
        alone[copies.astype(np.int64)] = False
        keep = alone[row]
        row, start, count, anchor = row[keep], start[keep], count[keep], anchor[keep]
        key = anchor >> shift << np.uint64(32) | ((anchor << np.uint64(bits)) >> np.uint64(32))
        outside = np.isin(key, np.concatenate(shared)) if shared else np.zeros(len(key), bool)
        _, inverse, times = np.unique(anchor, return_inverse=True, return_counts=True)
        some = np.flatnonzero(outside | (times[inverse] > 1) if len(key) else outside)
        first: dict[bytes, int] = {}
        sent: list[int] = []
        for k in some[np.argsort(ids[row[some]], kind="stable")]:
            body = data[start[k] : start[k] + count[k] + LENGTH - 1].tobytes()
            lead = first.setdefault(body, k)
            if lead == k or ids[row[lead]] == ids[row[k]]:
                sent.append(k)
            else:  # a smaller id of this very chunk has the same run
                begin = int(start[k] - at[row[k]])
                cuts.append((int(row[k]), begin, begin + len(body)))
        sent = np.array(sent, np.int64)
        sent = sent[np.argsort(anchor[sent], kind="stable")]
        meta = np.zeros(len(sent), _RUN)
        meta["row"], meta["start"], meta["size"], meta["doc_id"], meta["anchor"] = row[sent], start[sent] - at[row[sent]], count[sent] + LENGTH - 1, ids[row[sent]], anchor[sent]
        buckets, bodies, metas = [], [], []
        done = 0
        for bucket, raw in _split((anchor[sent] >> shift).astype(np.int64), meta):
            some = sent[done : done + len(raw) // _RUN.itemsize]
            done += len(some)
            buckets.append(bucket)
            bodies.append(b"".join([data[start[k] : start[k] + count[k] + LENGTH - 1].tobytes() for k in some]))
            metas.append(raw)
        if cuts:
            buckets.append(-1 - hash_of(name) % 1024)
            bodies.append(b"")
            metas.append(np.array(cuts, _CUT).tobytes())
        n = len(buckets)
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "chunk": pa.array([name] * n, pa.string()), "bytes": pa.array(bodies, pa.binary()), "meta": pa.array(metas, pa.binary())})

    return task


def hash_of(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little")


def equal_windows(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows of ``LENGTH`` bytes within the texts that end at ``ends``, and numbers that equal windows share.

    Bucket-pointer refinement: ``rank`` has the bucket of each suffix by its first ``depth`` bytes; suffixes alone in
    their bucket are final.
    """
    n = len(data)
    room = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - np.arange(n)  # bytes up to the end of the own text
    q = 8
    rank = np.arange(n, dtype=np.int64) + n  # a suffix too short for a q-gram is alone
    live = np.flatnonzero(room >= q)
    grams = np.zeros(len(live), np.uint64)
    for i in range(q):
        grams = grams << np.uint64(8) | data[live + i].astype(np.uint64)
    order = np.argsort(grams, kind="stable")
    depth = q

    def settle(live: np.ndarray, order: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Give each run of equal keys the place of its head in the order as bucket number; return the suffixes still in company."""
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(order)))
        number = np.repeat(head, size)
        rank[live[order]] = number
        return np.sort(live[order][np.repeat(size, size) > 1])

    g = grams[order]
    live = settle(live, order, np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else live
    while depth < LENGTH and len(live):
        step = min(depth, LENGTH - depth)
        live = live[room[live] >= depth + step]
        if not len(live):
            break
        here, later = rank[live], rank[live + step]
        order = np.lexsort((later, here))
        a, b = here[order], later[order]
        # numbers stay apart from those of other buckets: a refined bucket's numbers lie within its own range
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        inside = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(order)))
        fresh = rank.copy()
        fresh[live[order]] = np.repeat(a[head] + inside[head], size)
        rank = fresh
        live = np.sort(live[order][np.repeat(size, size) > 1])
        depth += step
    live = live[room[live] >= LENGTH]
    return live, rank[live]


def _decide(some: np.ndarray, sizes: np.ndarray, distinct: list[bytes], least: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each text of ``some``, of each of its windows the smallest id that holds it."""
    data = np.frombuffer(b"".join([distinct[k] for k in some]), np.uint8)
    ends = np.cumsum(sizes)
    place, group = equal_windows(data, ends)
    win = np.repeat(least[some], sizes)
    if len(place):
        order = np.argsort(group, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
        low = np.minimum.reduceat(win[place[order]], cut)
        win[place[order]] = np.repeat(low, np.diff(np.append(cut, len(order))))
    for k, a, e in zip(some, ends - sizes, ends, strict=True):
        yield int(k), win[a : e - LENGTH + 1]


def _judge(table: pa.Table) -> pa.Table:
    """Of one bucket: each chunk's cuts."""
    if table["bucket"][0].as_py() < 0:
        return pa.table({"chunk": table["chunk"], "cuts": table["meta"]})
    metas = [np.frombuffer(x.as_py(), _RUN) for x in table["meta"]]
    meta = np.concatenate(metas)
    source = np.repeat(np.arange(len(metas)), [len(m) for m in metas])
    source_ends = np.concatenate([[0], np.cumsum([len(m) for m in metas])])
    bodies: list[bytes] = []
    for blob, m in zip(table["bytes"], metas, strict=True):
        raw, at = blob.as_py(), 0
        for size in m["size"].tolist():
            bodies.append(raw[at : at + size])
            at += size
    # equal runs are one text, whose smallest id decides for all of them
    number: dict[bytes, int] = {}
    text = np.array([number.setdefault(b, len(number)) for b in bodies], np.int64)
    distinct = list(number)
    least = np.full(len(distinct), _LAST)
    np.minimum.at(least, text, meta["doc_id"])
    one = np.zeros(len(distinct), np.uint64)
    one[text] = meta["anchor"]
    _, inverse, times = np.unique(one, return_inverse=True, return_counts=True)
    several = np.flatnonzero(times[inverse] > 1)  # texts that share an anchor with another one
    several = several[np.argsort(one[several], kind="stable")]
    sizes = np.array([len(distinct[k]) for k in several], np.int64)
    # a member with a larger id than its text's smallest goes as a whole; of the others single windows may go
    whole = least[text] < meta["doc_id"]
    rest = np.flatnonzero(~whole)
    rest = rest[np.argsort(text[rest], kind="stable")]
    first = np.searchsorted(text[rest], np.arange(len(distinct) + 1))
    cuts = [array.array("I") for _ in metas]
    # texts of different anchors have no window in common: a few arrays of bounded size, one after the other
    edge = np.flatnonzero(np.concatenate([[True], one[several][1:] != one[several][:-1]])) if len(several) else np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(sizes)])
    i = 0
    while i < len(edge):
        j = max(i + 1, int(np.searchsorted(before[edge], before[edge[i]] + ARRAY, side="right")) - 1)
        j = len(edge) if before[-1] - before[edge[i]] <= ARRAY else j
        lo, hi = edge[i], edge[j] if j < len(edge) else len(several)
        for t, smallest in _decide(several[lo:hi], sizes[lo:hi], distinct, least):
            gone = smallest < least[t]
            if gone.any():
                turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
                for k in rest[first[t] : first[t + 1]].tolist():
                    row, start = int(meta["row"][k]), int(meta["start"][k])
                    for x, y in turns:
                        cuts[source[k]].extend((row, start + x, start + y - 1 + LENGTH))
        i = j
    out = []
    for k, m in enumerate(metas):
        full = m[whole[source_ends[k] : source_ends[k + 1]]]
        own = np.zeros(len(full), _CUT)
        own["row"], own["start"], own["end"] = full["row"], full["start"], full["start"] + full["size"]
        out.append(own.tobytes() + np.frombuffer(cuts[k].tobytes(), "<u4").tobytes())
    return pa.table({"chunk": table["chunk"], "cuts": pa.array(out, pa.binary())})


def _cut_texts(with_text: bool):
    def task(text: pa.Table, cuts: pa.Table) -> pa.Table:
        data, at, ids, null = _text_of(text, cuts)
        all_cuts = np.concatenate([np.zeros(0, _CUT), *[np.frombuffer(x.as_py(), _CUT) for x in cuts["cuts"]]])
        steps = np.zeros(len(data) + 1, np.int64)
        base = at[all_cuts["row"].astype(np.int64)]
        np.add.at(steps, base + all_cuts["start"], 1)
        np.add.at(steps, base + all_cuts["end"], -1)
        gone = np.cumsum(steps[:-1]) > 0
        n = len(at) - 1
        removed, spans, shas, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
        for k in range(n):
            g = gone[at[k] : at[k + 1]]
            body = data[at[k] : at[k + 1]]
            if g.any():
                removed[k] = g.sum()
                spans[k] = int(g[0]) + int((g[1:] & ~g[:-1]).sum())
                body = body[~g]
            shas.append(hashlib.sha256(body).hexdigest())
            if with_text:
                kept.append(body.tobytes())
        cols = {"doc_id": pa.array(ids, pa.int64(), mask=null), "n_bytes": pa.array(np.diff(at)), "n_removed": pa.array(removed), "n_spans": pa.array(spans), "kept_sha256": pa.array(shas, pa.string())}
        if with_text:
            cols["kept"] = pa.array(kept, pa.binary())
        return pa.table(cols)

    return task


def bucket_bits(size: int, partitions: int) -> int:
    """Leading bits that number the buckets: at least two for each shuffle partition, and one for each ``BUCKET`` bytes of text."""
    return min(16, max(6, math.ceil(math.log2(partitions)) + 1, math.ceil(math.log2(max(size / BUCKET, 1)))))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, owner: str = "query") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the bytes left): one row for each input row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = steady(rows, owner)  # chunks are named by the place of their rows
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = bucket_bits(size, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = rows.mapInArrow(tidy(_texts), "chunk string, bytes binary, starts binary, ids binary, nulls binary").groupBy("chunk")
    hashes = rows.mapInArrow(tidy(_hashes(bits)), "chunk string, kind int, bucket int, packed binary")
    answers = hashes.groupBy("kind", "bucket").applyInArrow(tidy(_answers), "chunk string, kind int, bucket int, packed binary")
    shared = texts.cogroup(answers.groupBy("chunk")).applyInArrow(tidy(_shared_runs(bits)), _RUNS)
    cuts = shared.groupBy("bucket").applyInArrow(tidy(_judge), "chunk string, cuts binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return texts.cogroup(cuts.groupBy("chunk")).applyInArrow(tidy(_cut_texts(with_text)), schema)
