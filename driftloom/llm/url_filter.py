"""URL filter over a sorted array of digests.

The rules' texts (host and path prefix) are hashed to 64-bit xxhash keys and sorted; keys, verdicts and the full texts
lie in one file, which Spark hands to every executor (``addFile``) and which workers map into memory, so a list of any
size costs pages, not heap. A batch of URLs makes one array of candidate keys, each host suffix with each path
prefix whose lengths occur among the rules, that is probed by one vectorised binary search; a hit counts only if the
stored full text is the candidate's, so collisions of digests decide nothing. The longest fitting rule wins (of equally
long ones, that of the longer host).

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule and the default verdict;
a null id stays null; repeated rows are judged alike, and of rules that fit equally none is chosen by chance (the longer host's); a very long URL is
taken whole, with as many candidates as rules have host and path lengths; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_FOLD = {c: c + 32 for c in range(65, 91)}
_KEYS = np.dtype([("key", "<u8"), ("at", "<u8"), ("len", "<u4"), ("host", "<u2"), ("block", "<u2")])


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    found = _URL.match(url, at)
    return found[1].translate(_FOLD), found[2]


def write_rules(path: str, rules: Sequence[tuple[str, str]]) -> None:
    """The file: number of keys, number of path lengths, those lengths, the sorted keys, the texts."""
    texts = {rule: verdict for verdict, rule in rules}
    keyed = sorted((xxhash.xxh64_intdigest(r.encode()), r) for r in texts)
    table, blob = np.zeros(len(keyed), _KEYS), bytearray()
    for i, (key, rule) in enumerate(keyed):
        raw = rule.encode()
        table[i] = (key, len(blob), len(raw), rule.index("/"), texts[rule] == "block")
        blob += raw
    lengths = np.array(sorted({len(r) - r.index("/") for r in texts}), "<u8")
    with open(path, "wb") as out:
        out.write(np.array([len(table), len(lengths)], "<u8").tobytes() + lengths.tobytes() + table.tobytes() + bytes(blob))


class DigestArray:
    """A mapped rules file."""

    def __init__(self, path: str):
        self.raw = np.memmap(path, np.uint8, "r")
        n, m = (int(x) for x in self.raw[:16].view("<u8"))
        self.lengths = [int(x) for x in self.raw[16 : 16 + 8 * m].view("<u8")]
        start = 16 + 8 * m
        self.table = self.raw[start : start + n * _KEYS.itemsize].view(_KEYS)
        self.keys = self.table["key"]
        self.hosts = np.unique(self.table["host"]).tolist()
        self.texts = self.raw[start + n * _KEYS.itemsize :]

    def probe(self, texts: list[str]) -> np.ndarray:
        """For each candidate text, the place of the rule with this very text, or -1."""
        if not texts or not len(self.keys):
            return np.full(len(texts), -1)
        keys = np.fromiter((xxhash.xxh64_intdigest(t.encode()) for t in texts), np.uint64, len(texts))
        place = np.searchsorted(self.keys, keys)
        out = np.full(len(texts), -1)
        for i in np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] == keys):
            at, raw = int(place[i]), texts[i].encode()
            while at < len(self.keys) and self.keys[at] == keys[i]:  # several rules may share a digest
                row = self.table[at]
                if self.texts[int(row["at"]) : int(row["at"]) + int(row["len"])].tobytes() == raw:
                    out[i] = at
                at += 1
        return out

    def candidates(self, host: str, path: str) -> list[str]:
        """The host's suffixes at a dot (or all of it) that are as long as a rule's host, each with the path's prefixes that are as long as a rule's path."""
        ends = [path[:n] for n in self.lengths if n <= len(path)]
        cuts = [len(host) - n for n in self.hosts if n <= len(host)]
        return [host[c:] + p for c in cuts if not c or host[c - 1] == "." for p in ends]

    def judge(self, urls: Sequence[str | None], default: str) -> tuple[list, list, list, list]:
        """Hosts, paths, rules and verdicts."""
        parts = [split_url(u) for u in urls]
        texts: list[str] = []
        of: list[int] = []
        for i, (host, path) in enumerate(parts):
            new = self.candidates(host, path) if host else []
            texts += new
            of += [i] * len(new)
        best: dict[int, tuple[int, int, int]] = {}
        places = self.probe(texts)
        for j in np.flatnonzero(places >= 0):
            row = self.table[places[j]]
            best[of[j]] = max(best.get(of[j], (-1, -1, -1)), (len(texts[j]), int(row["host"]), int(j)))
        rules = [texts[best[i][2]] if i in best else None for i in range(len(parts))]
        verdicts = [("block" if self.table[places[best[i][2]]]["block"] else "allow") if i in best else default for i in range(len(parts))]
        return [p[0] for p in parts], [p[1] for p in parts], rules, verdicts


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict."""
    spark = pages.sparkSession
    name = f"driftloom-rules-{uuid.uuid4().hex}"
    here = os.path.join(tempfile.mkdtemp(prefix="driftloom-"), name)  # the driver's own copy; executors fetch it from the driver
    write_rules(here, rules)
    spark.sparkContext.addFile(here)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(name))
        for batch in batches:
            host, path, rule, verdict = array.judge(batch.column(1).to_pylist(), default)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in (host, path, rule, verdict))], ["page_id", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
