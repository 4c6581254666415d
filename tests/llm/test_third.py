"""Fill-in-middle, SetSketch near-dedup and the Merkle manifest against brute force, and their results for odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.llm import fim, merkle, near_dedup
from tests.llm.test_dealt import CLASHES, SCHEMA, odd_rows, rows_of


@pytest.fixture(scope="module")
def odd(spark):
    marked = [(20, "a \x01 b\x02c \x02\x01e", "en", "a", 1), (21, "has <P> in it", "en", "a", 2), (22, "\U0001f600 x y  ", "zh", "é", 3), (23, "<P ><S <M end <", "en", "b", 4), (None, "Null Id AGAIN", None, None, None)]
    df = spark.createDataFrame(odd_rows() + marked, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in [*CLASHES, "marked", "digest", "form", "grp", "load", "node", "place", "total", "registers", "band"]}).repartition(3)


# ---- 11: fill in the middle ----

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_fim(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check_fim(docs):
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted(((*(w := plain_fim(i, t))[:5], sha(w[5]), sha(t or "")) for i, t in texts), key=repr)
    got = rows_of(fim.digests(fim.fill_in_middle(docs)), "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    assert got == want


def test_fim_equals_the_definition(spark, sf, odd):
    check_fim(spark.read.parquet(f"{sf}/documents.parquet"))
    check_fim(odd)
    check_fim(odd.filter("false"))


def test_fim_of_random_texts(spark):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t\x0b", "a", "bc", "é", "\U0001f600", "\x01", "\x02", "\x02e", "\x02c", "<", ">", "P", "<S", "M>", " ", "$1", "\\", "<P>"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for k in range(3000)]
    check_fim(spark.createDataFrame(rows, "doc_id long, text string"))


def test_fim_takes_very_long_texts(spark):
    check_fim(spark.createDataFrame([(k, f"w{k} " * 400_000 + " " * 300_000) for k in range(4)], "doc_id long, text string"))


def test_fim_has_no_python_on_its_way(spark, sf):
    plan = fim.digests(fim.fill_in_middle(spark.read.parquet(f"{sf}/documents.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert plan.count("regexp_replace") == 1  # each text is cut once


# ---- 12: near-dedup by SetSketch ----


def word_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain_copies(rows, percent=85):
    """Every row's set size and component, from all pairs."""
    sets = [word_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * len(sets[i] | sets[j]):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(find(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


def families(seed=4, sizes=(40, 25, 3, 2), words=120):
    """Near copies about a base, some near each other only through it, and texts that are likely but not linked."""
    rng, rows = random.Random(seed), []
    for f, size in enumerate(sizes):
        base = [f"w{rng.randrange(4000)}" for _ in range(words)]
        for k in range(size):
            text = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3, 4, 5)) if k else 0):
                text[rng.randrange(words)] = f"x{rng.randrange(9999)}"
            rows.append(" ".join(text) if rng.random() < 0.9 else "  ".join(text).upper())
    rows += [" ".join(f"w{rng.randrange(4000)}" for _ in range(rng.choice((1, 3, 5, 6, 9, 40, 200)))) for _ in range(40)]
    rows += ["a b c", "A  b c", "a b c d", "a b c d e f g h i j", "a b c d e f g h i j k", "", None, " \n"]
    rng.shuffle(rows)
    return list(enumerate(rows))


COLS = ("doc_id", "n_shingles", "component_id", "kept")


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(1)
    for j in (0.5, 0.85, 0.95):
        got = []
        for n, m in [(1000, 1000)] * 60 + [(900, 1000)] * 30:
            both = round((n + m) * j / (1 + j))
            if both > min(n, m):
                continue
            s = rng.integers(0, 2**63, n + m - both).astype(np.uint64)
            x, y = near_dedup.sketch(np.sort(s[:n])), near_dedup.sketch(np.sort(s[n - both :]))
            got.append(near_dedup.estimate(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([float(n)]), np.array([float(m)]))[0])
        assert abs(np.mean(got) - j) < 0.015 and np.std(got) < 0.06
    s = np.sort(rng.integers(0, 2**63, 100_000).astype(np.uint64))
    assert (near_dedup.merge(near_dedup.sketch(s[:700]), near_dedup.sketch(s[300:])) == near_dedup.sketch(s)).all()
    ends = np.array([0, 0, 5, 40_000, 40_000, 99_000, 100_000, 100_000])
    least = near_dedup.least_hashes(s, ends)
    for k in range(len(ends) - 1):
        if ends[k] < ends[k + 1]:
            assert (near_dedup.registers(least)[k] == near_dedup.sketch(s[ends[k] : ends[k + 1]])).all()


def test_all_overlaps_at_once_are_exact():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 3000)).astype(np.uint64)) for _ in range(30)]
    got = near_dedup.overlaps(sets[:12], sets[12:])
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[12 + j])) for i in range(12) for j in range(18))


@pytest.mark.parametrize("block", [512, 7])
def test_near_copies_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)  # small blocks: shards and buckets of many
    rows = families()
    assert rows_of(near_dedup.near_copies(spark.createDataFrame(rows, "doc_id long, text string")), *COLS) == plain_copies(rows)


def test_near_copies_of_the_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(near_dedup.near_copies(docs), *COLS) == plain_copies(rows)


def test_near_copies_of_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert rows_of(near_dedup.near_copies(odd), *COLS) == plain_copies(rows)
    assert near_dedup.near_copies(odd.filter("false")).count() == 0
    # a class whose rows have no id at all still finds its near copies
    base = [f"v{k}" for k in range(90)]
    some = [(None, " ".join(base)), (None, " ".join([*base[:-1], "z"])), (7, " ".join(["y", *base[1:]])), (None, "other words " * 30)]
    assert rows_of(near_dedup.near_copies(spark.createDataFrame(some, "doc_id long, text string")), *COLS) == plain_copies(some)


# ---- 13: Merkle manifest ----


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def plain_tree(nodes):
    """The root, and for each leaf its (place, siblings) by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for leaf, k in enumerate(at):
            run = runs[k // 8]
            paths[leaf].append((k % 8, run[: k % 8] + run[k % 8 + 1 :]))
        at = [k // 8 for k in at]
        nodes = [H(*run) for run in runs]
    return nodes[0], paths


def plain_manifest(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = {}
    for r in rows:
        bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        text = r["text"].translate(lower) if bad and r["text"] is not None else r["text"]
        by.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"]), plain_leaf(r, text), r["doc_id"]))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: plain_tree([y[2] for y in sorted(by[x], key=lambda y: y[:3])]) for x in langs}
    root, tops = plain_tree([trees[x][0] for x in langs]) if langs else (None, [])
    out = []
    for x, top in zip(langs, tops, strict=True):
        for (_, _, leaf, other, doc_id), path in zip(sorted(by[x], key=lambda y: y[:3]), trees[x][1], strict=True):
            fold = other
            for k, others in [*path, *top]:
                fold = H(*others[:k], fold, *others[k:])
            out.append((doc_id, leaf, trees[x][0], root, H(*(s for _, others in [*path, *top] for s in others)), fold, fold == root))
    return sorted(out, key=repr)


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def manifest(docs, levels):
    return rows_of(merkle.manifest(docs, {"text": merkle.lower_ascii(docs["text"])}, merkle.tampered(docs["doc_id"]), levels=levels), *MANIFEST)


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest_equals_the_definition(spark, sf, odd, levels):
    """With blocks of one level: 200 rows make tiers of several."""
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd, odd.filter("false"), odd.limit(1)):
        docs = docs if docs.columns[-1] == "n_chars" else docs.select("*").cache()
        assert manifest(docs, levels) == plain_manifest(docs.collect())


def test_manifest_of_many_groups_and_equal_ids(spark):
    rows = [(k % 50, f"T{k % 9}", f"l{k % 77}" if k % 5 else None, None, k) for k in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert manifest(docs, 1) == plain_manifest(docs.collect())


def test_manifest_finds_every_change(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = merkle.manifest(docs, {"text": F.concat(docs["text"], F.lit(" "))}, docs["doc_id"] % 7 == 0)
    assert {r["doc_id"] for r in got.filter("not verified").collect()} == {r["doc_id"] for r in docs.filter("doc_id % 7 = 0").collect()}
    assert merkle.manifest(docs).filter("not verified").count() == 0


def test_traversal_packs_and_folds():
    rng = random.Random(1)
    for n in (1, 2, 8, 9, 64, 65, 513, 600):
        leaves = [rng.randbytes(32) for _ in range(n)]
        below = [[] for _ in leaves]
        root = merkle.traverse(leaves, None, below)
        assert all(merkle.unpack(merkle.pack(p)) == p and merkle.fold(leaf, p) == root for leaf, p in zip(leaves, below, strict=True))
        assert (root.hex(), proofs := [[(k, [x.hex() for x in o]) for k, o in p] for p in below]) == (plain_tree([x.hex() for x in leaves])[0], plain_tree([x.hex() for x in leaves])[1])
