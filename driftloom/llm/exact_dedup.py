"""Exact dedup by composable polynomial fingerprints.

Every text, without its ASCII white space, gets a fingerprint: a polynomial in its bytes modulo two primes.
Chunks are hashed independently of each other; the hash of a concatenation follows from those of its parts by
shifting the left one by the right one's length, so huge texts never need more than a chunk at a time and their
chunks may be hashed anywhere (here one after the other in the task that reads the text, since a text is one value of a row). Rows with equal fingerprint and length are then compared text against text, chunk
by chunk; rows that differ although their fingerprints agree are told apart by their SHA-256.

Defined results: null and empty texts are equal to each other (empty after normalisation); the row with most code
points in its original text stays, then the smallest doc_id (null doc_id last); repeated rows are members like any
others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialise
from .textarrays import SPACE, SPACES, runs, tidy, utf8

#: Two primes below 2**31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
PIECE = 1 << 16

_tables: list[np.ndarray] = []


def _falling(k: int, n: int) -> np.ndarray:
    """base**(n-1) ... base**0 modulo prime k."""
    if not _tables:
        for p, b in zip(PRIMES, BASES, strict=True):
            out = [1] * PIECE
            for i in range(1, PIECE):
                out[i] = out[i - 1] * b % p
            _tables.append(np.array(out[::-1], np.uint64))
    return _tables[k][PIECE - n :]


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """The (hash, hash, length) of a concatenation, from those of its two parts."""
    n = right[2]
    a, b = ((left[k] * pow(BASES[k], n, PRIMES[k]) + right[k]) % PRIMES[k] for k in (0, 1))
    return a, b, left[2] + n


def fingerprint(data: np.ndarray) -> tuple[int, int, int]:
    """(hash, hash, length) of bytes; whole chunks are hashed all at once, then combined."""
    out = (0, 0, 0)
    n = len(data)
    if n > PIECE:
        whole = n // PIECE
        for at in range(0, whole, 16):
            block = data[at * PIECE : min(at + 16, whole) * PIECE].reshape(-1, PIECE).astype(np.uint64) + np.uint64(1)
            for a, b in zip(*(block @ _falling(k, PIECE) % np.uint64(PRIMES[k]) for k in (0, 1)), strict=True):
                out = combine(out, (int(a), int(b), PIECE))
        data = data[whole * PIECE :]
    if len(data):
        block = data.astype(np.uint64) + np.uint64(1)
        last = [int(block @ _falling(k, len(data)) % np.uint64(PRIMES[k])) for k in (0, 1)]
        out = combine(out, (last[0], last[1], len(data)))
    return out


def _pieces(text: str) -> Iterator[bytes]:
    """A text's normalised bytes, chunk by chunk."""
    for i in range(0, len(text), PIECE):
        yield text[i : i + PIECE].encode().translate(None, SPACES)


def same_text(a: str, b: str) -> bool:
    """Are two texts equal but for white space? Chunks are compared as they come; no whole copy is made."""
    if a == b:
        return True
    left, right, x, y = _pieces(a), _pieces(b), b"", b""
    while True:
        while not x and (p := next(left, None)) is not None:
            x = p
        while not y and (p := next(right, None)) is not None:
            y = p
        n = min(len(x), len(y))
        if not n:
            return not x and not y
        if x[:n] != y[:n]:
            return False
        x, y = x[n:], y[n:]


def _scan(with_text: bool):
    """Arrow batches of (doc_id, text) to fingerprints, with or without the texts."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            for i, j in runs(at):
                part, rel = data[at[i] : at[j]], at[i : j + 1] - at[i]
                points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                keep = ~SPACE[part]
                to = np.concatenate([[0], np.cumsum(keep)])[rel]
                norm = part[keep]
                prints, shas = [], []
                for a, b in zip(to[:-1], to[1:], strict=True):
                    one = norm[a:b]
                    h, g, _ = fingerprint(one)
                    prints.append(h << 31 | g)
                    if not with_text:
                        shas.append(hashlib.sha256(one).hexdigest())
                cols = {"doc_id": batch.column(0).slice(i, j - i), "fp": pa.array(prints, pa.int64()), "n_bytes": pa.array(np.diff(to), pa.int64())}
                if with_text:
                    cols["text"] = batch.column(1).slice(i, j - i)
                else:
                    cols |= {"n_points": pa.array(np.diff(points[rel]), pa.int64()), "sha": pa.array(shas, pa.string())}
                yield pa.RecordBatch.from_pydict(cols)

    return scan


def _differ(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (fp, n_bytes, text, other): the keys and SHA-256 of rows whose texts differ."""
    for batch in batches:
        found: dict[str, list] = {"fp": [], "n_bytes": [], "sha": []}
        texts, others = batch.column(2), batch.column(3)
        for i in range(batch.num_rows):
            if not same_text(texts[i].as_py() or "", others[i].as_py() or ""):
                found["fp"].append(batch.column(0)[i].as_py())
                found["n_bytes"].append(batch.column(1)[i].as_py())
                found["sha"].append(hashlib.sha256(b"".join(_pieces(texts[i].as_py() or ""))).hexdigest())
        yield pa.RecordBatch.from_pydict({"fp": pa.array(found["fp"], pa.int64()), "n_bytes": pa.array(found["n_bytes"], pa.int64()), "sha": pa.array(found["sha"], pa.string())})


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: str = "query") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each input row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    info = materialise(rows.mapInArrow(tidy(_scan(False)), "doc_id long, fp long, n_bytes long, n_points long, sha string"), owner)
    key = ["fp", "n_bytes"]
    leaders = info.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lead")).filter("n > 1")
    texts = rows.mapInArrow(tidy(_scan(True)), "doc_id long, fp long, n_bytes long, text string")
    refs = materialise(
        texts.join(leaders, key).filter(F.col("doc_id").eqNullSafe(F.col("lead"))).select(*key, F.col("text").alias("other")).dropDuplicates(key),
        owner,
    )
    differ = materialise(texts.join(refs, key).select(*key, "text", "other").mapInArrow(tidy(_differ), "fp long, n_bytes long, sha string").distinct(), owner)
    apart = differ.withColumn("alt", F.col("sha"))
    full = info.join(apart, [*key, "sha"], "left").withColumn("alt", F.coalesce("alt", F.lit("")))
    # largest text first, then the smallest doc_id, null last
    best: Column = F.min(F.struct((-F.col("n_points")).alias("points"), F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("keep_id")))
    groups = full.groupBy(*key, "alt").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    # written first, so that the join's own exchange can be split where one group holds much of the table
    groups = materialise(groups.select(*key, "alt", "group_size", F.col("best.keep_id").alias("keep_id")), owner)
    return full.join(groups, [*key, "alt"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: str = "query") -> DataFrame:
    """The row that stays of each group, with all columns of ``docs``; of wholly repeated rows one."""
    cols, place = docs.columns, docs.columns.index(text_col)
    sha = "text_sha256" if "text_sha256" not in cols else f"text_sha256_{len(cols)}"

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas = [hashlib.sha256((x.as_py() or "").encode().translate(None, SPACES)).hexdigest() for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shas, pa.string())], [*batch.schema.names, sha])

    schema = T.StructType([*docs.schema.fields, T.StructField(sha, T.StringType())])
    stay = exact_groups(docs, id_col, text_col, owner).filter("kept").select("doc_id", "text_sha256").distinct().alias("stay")
    marked = docs.mapInArrow(tidy(mark), schema).alias("marked")
    same = F.col(f"marked.{id_col}").cast("long").eqNullSafe(F.col("stay.doc_id")) & (F.col(f"marked.{sha}") == F.col("stay.text_sha256"))
    found = marked.join(stay, same, "left_semi")
    # repeated rows have the same id and text: one of them is any of them but for other columns, whose order decides
    others = [F.col(f"`{c}`").cast("string") for c in cols if c not in (id_col, text_col)]
    first = F.row_number().over(Window.partitionBy(id_col, sha).orderBy(F.length(text_col).desc(), F.md5(F.to_json(F.struct(*others))) if others else F.lit(0), text_col))
    place_col = f"{sha}_place"
    return found.withColumn(place_col, first).filter(F.col(place_col) == 1).select(*[F.col(f"`{c}`") for c in cols])
