"""Quality by weak labels.

Overlapping heuristics each vote good, bad or abstain on a document. Expectation-maximisation over the counts of all vote
patterns of the whole corpus (at most 3 ** 7 of them, aggregated in Spark) estimates latent classes of documents: their
shares and, for each class and labeller, how it votes. Two models are fitted, both from the votes alone and with a
twentieth of a document a cell as the only prior: one class of bad documents whose faults are independent, and a class of bad documents for
each labeller's fault, which also takes in labellers that see the same fault. The better one by Akaike's information
criterion stays; the class with the fewest bad votes is the good one. No true label is used. The posterior of each pattern then
labels documents, and these soft labels train a hashed linear scorer (words, word endings and word shapes, as shares of the
document's words), which scores every document.

The scorer's fit uses a documented bounded sample: the ``SAMPLE`` documents with the smallest md5 of their id.

Defined results: null ids pass (the fit leaves them out); ties don't arise; a very long text is scored in one piece, in memory of
its own size; null counts as empty; a text without words has posterior and score 0 and is not kept; repeated rows
score alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import LOWER, SPACE, byte_table, mix, run_hashes, runs, spans_of, tidy, utf8

SAMPLE = 4000
BUCKETS = 1 << 17
#: Rounds of EM at most; pseudo-documents of each cell.
ROUNDS, PRIOR = 500, 0.05
#: Name, measure, and where it votes: good within the first range, bad outside the second, else abstain.
LABELLERS = (
    ("symbols", 0, (0.0, 0.08), (0.0, 0.30)),  # of # $ % & * and the like, for each word
    ("bars", 1, (0.0, 0.05), (0.0, 0.20)),  # of | for each word
    ("capitals", 2, (0.0, 0.25), (0.0, 0.60)),  # share of A-Z among ASCII letters
    ("shouting", 3, (0.0, 0.05), (0.0, 0.30)),  # of ! for each word
    ("variety", 4, (0.30, 1.0), (0.15, 1.0)),  # distinct words, for each of at most 200 words
    ("word length", 5, (2.5, 8.0), (1.5, 12.0)),  # letters for each word
    ("repeated lines", 6, (0.0, 0.10), (0.0, 0.30)),  # share of lines (of four or more) that are not the first of their kind
)
_SYMBOL, _LETTER, _UPPER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*<>{}[]=_\\^~@"]] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[192:] = True  # of a longer character only its first byte
_UPPER[65:91] = True
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True
_RAW = byte_table(lower=False, seed=9)


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[at[1:]] - total[at[:-1]]


def _distinct(hashes: np.ndarray, first: np.ndarray, most: int | None) -> np.ndarray:
    out = np.zeros(len(first) - 1)
    for k, (a, e) in enumerate(zip(first[:-1], first[1:], strict=True)):
        if e > a:
            out[k] = len(np.unique(hashes[a : min(e, a + most) if most else e]))
    return out


def measures(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Measures of each row; and the words' starts, ends and hashes, and each row's first word."""
    starts, ends = spans_of(~SPACE[data], at)
    hashes = run_hashes(data, starts, ends, LOWER)
    first = np.searchsorted(starts, at)
    n = np.diff(first)
    per = np.maximum(n, 1)
    a, e = spans_of(data != 10, at)
    lines, head = run_hashes(data, a, e, _RAW), np.searchsorted(a, at)
    n_lines = np.diff(head)
    # variety is taken over every window of 200 words by way of the words' places, so long texts are not short of it
    block = (np.arange(len(hashes)) - np.repeat(first[:-1], n)) // 200
    pairs = mix(hashes + block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.stack([
        _sums(_SYMBOL[data], at) / per,
        _sums(data == ord("|"), at) / per,
        _sums(_UPPER[data], at) / np.maximum(_sums(_ASCII[data], at), 1),
        _sums(data == ord("!"), at) / per,
        np.where(n > 0, _distinct(pairs, first, None) / per, 1.0),
        _sums(_LETTER[data], at) / per,
        1 - np.where(n_lines >= 4, _distinct(lines, head, None) / np.maximum(n_lines, 1), 1.0),
    ], axis=1)
    return out, starts, ends, hashes, first


def votes(measured: np.ndarray) -> np.ndarray:
    """0 abstain, 1 good, 2 bad, for each row and labeller."""
    out = np.zeros(measured.shape, np.int64)
    for k, (_, which, good, fair) in enumerate(LABELLERS):
        x = measured[:, which]
        out[:, k] = np.where((x >= good[0]) & (x <= good[1]), 1, np.where((x >= fair[0]) & (x <= fair[1]), 0, 2))
    return out


def pattern_of(vote: np.ndarray) -> np.ndarray:
    return vote @ (3 ** np.arange(len(LABELLERS)))


@dataclass(frozen=True)
class LabelModel:
    """Share of each latent class (the good one first) and, for class and labeller, how often it votes each way."""

    shares: np.ndarray
    classes: np.ndarray

    @property
    def good(self) -> float:
        return float(self.shares[0])

    @property
    def table(self) -> np.ndarray:
        """For bad (0) and good (1) documents and each labeller, how often it votes each way."""
        bad = self.shares[1:] / self.shares[1:].sum()
        return np.stack([np.tensordot(bad, self.classes[1:], 1), self.classes[0]])

    def logs(self, patterns: np.ndarray) -> np.ndarray:
        """Log probability of each pattern with each class."""
        vote = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
        return np.log(self.shares) + np.stack([np.log(c[np.arange(len(LABELLERS)), vote]).sum(1) for c in self.classes], axis=1)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a document with this pattern is good."""
        logs = self.logs(patterns)
        return np.exp(logs[:, 0] - np.logaddexp.reduce(logs, axis=1))


def _latent_classes(patterns: np.ndarray, counts: np.ndarray, belong: np.ndarray) -> tuple[LabelModel, float]:
    """Expectation-maximisation from the memberships ``belong``; the model and its information criterion."""
    vote = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    each = np.stack([vote == v for v in range(3)], axis=2).astype(float)
    last = -np.inf
    for _ in range(ROUNDS):
        weight = belong * counts[:, None]
        table = np.einsum("pc,plv->clv", weight, each) + PRIOR
        shares = weight.sum(0) + 1.0
        model = LabelModel(shares / shares.sum(), table / table.sum(2, keepdims=True))
        logs = model.logs(patterns)
        total = np.logaddexp.reduce(logs, axis=1)
        belong = np.exp(logs - total[:, None])
        fit = float(counts @ total)
        if fit - last < 1e-7 * abs(fit):
            break
        last = fit
    order = np.argsort(model.classes[:, :, 2].sum(1), kind="stable")  # fewest bad votes first
    used = ((np.einsum("pc,plv->clv", belong * counts[:, None], each) > 1).sum(2) - 1).clip(0).sum() + belong.shape[1] - 1  # parameters that documents speak to
    return LabelModel(model.shares[order], model.classes[order]), fit - float(used)


def learn_labels(patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
    """The better of both models (see the module); they start from: good if no labeller says bad, else bad by these faults."""
    bad = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 == 2
    good = np.where(bad.any(1), 0.1, 0.9)
    start = np.stack([good, 1 - good], axis=1)
    faults = np.where(bad.any(1)[:, None], bad / np.maximum(bad.sum(1), 1)[:, None], 1 / len(LABELLERS))
    both = [_latent_classes(patterns, counts, start), _latent_classes(patterns, counts, np.concatenate([good[:, None], (1 - good)[:, None] * faults], axis=1))]
    return max(both, key=lambda x: x[1])[0]


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Four buckets for each word: the word, its last three bytes, its shape, and whether it repeats the word before."""
    again = np.concatenate([[False], hashes[1:] == hashes[:-1]]).astype(np.uint64)
    tail = np.maximum(starts, ends - 3)
    last = data[ends - 1].astype(np.uint64) << np.uint64(16) | data[np.maximum(ends - 2, tail)].astype(np.uint64) << np.uint64(8) | data[tail].astype(np.uint64)
    size = np.minimum(ends - starts, 15).astype(np.uint64)
    head, foot = data[starts], data[ends - 1]
    shape = size << np.uint64(8) | (_UPPER[head].astype(np.uint64) << np.uint64(4)) | (_UPPER[data[np.minimum(starts + 1, ends - 1)]].astype(np.uint64) << np.uint64(3)) | (_LETTER[foot] | (foot >= 128)).astype(np.uint64)
    return np.stack([(mix(x + np.uint64(k << 40)) % np.uint64(BUCKETS)).astype(np.int64) for k, x in enumerate((hashes, last, shape, again), 1)], axis=1)


@dataclass(frozen=True)
class Model:
    labels: LabelModel
    weights: np.ndarray
    bias: float


def _scan(work):
    """Arrow batches of (doc_id, text), chunk by chunk, through ``work(batch slice, data, at)``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            for i, j in runs(at):
                yield work(batch.column(0).slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i])

    return run


def _patterns(ids: pa.Array, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"pattern": pa.array(pattern_of(votes(measures(data, at)[0])))})


def _bags(ids: pa.Array, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    measured, starts, ends, hashes, first = measures(data, at)
    buckets = features(data, starts, ends, hashes).astype("<i4") if len(starts) else np.zeros((0, 4), "<i4")
    which, share = [], []
    for a, e in zip(first[:-1], first[1:], strict=True):
        b, n = np.unique(buckets[a:e], return_counts=True)
        which.append(b.tobytes())
        share.append((n / max(e - a, 1)).astype("<f4").tobytes())
    return pa.RecordBatch.from_pydict({"doc_id": ids, "pattern": pa.array(pattern_of(votes(measured))), "which": pa.array(which, pa.binary()), "share": pa.array(share, pa.binary())})


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Label model over all documents, scorer over the bounded sample."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = rows.mapInArrow(tidy(_scan(_patterns)), "pattern long").groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).toPandas()
    labels = learn_labels(seen["pattern"].to_numpy(), seen["n"].to_numpy(float)) if len(seen) else LabelModel(np.full(2, 0.5), np.full((2, len(LABELLERS), 3), 1 / 3))
    chosen = rows.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    got = rows.join(F.broadcast(chosen), "doc_id").mapInArrow(tidy(_scan(_bags)), "doc_id long, pattern long, which binary, share binary").toArrow()  # at most ``sample`` ids
    if not got.num_rows:
        return Model(labels, np.zeros(BUCKETS), 0.0)
    got = got.sort_by([("doc_id", "ascending"), ("which", "ascending")])
    which = [np.frombuffer(x.as_py(), "<i4") for x in got["which"]]
    owner = np.repeat(np.arange(len(which)), [len(x) for x in which])
    which, share = np.concatenate(which), np.concatenate([np.frombuffer(x.as_py(), "<f4") for x in got["share"]]).astype(float)
    y = labels.posterior(got["pattern"].to_numpy())
    w, b, m, v = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    steps = 120
    for step in range(1, steps + 1):
        z = b + np.bincount(owner, weights=w[which] * share, minlength=len(y))
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(y)
        grad = np.append(np.bincount(which, weights=g[owner] * share, minlength=BUCKETS) + 1e-6 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.3 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        w, b = w - move[:-1], b - move[-1]
    return Model(labels, w, float(b))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, posterior (of the labellers), score (of the scorer; higher: good), predicted, kept."""
    labels, weights, bias = model.labels, model.weights.astype(np.float32), model.bias

    def work(ids: pa.Array, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        measured, starts, ends, hashes, first = measures(data, at)
        posterior, out, some = labels.posterior(pattern_of(votes(measured))), np.zeros(len(at) - 1), np.diff(first) > 0
        if some.any():
            total = np.concatenate([[0.0], np.cumsum(weights[features(data, starts, ends, hashes)].sum(1, dtype=np.float64))])
            z = bias + (total[first[1:]] - total[first[:-1]])[some] / np.diff(first)[some]
            out[some] = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        posterior = np.where(some, posterior, 0.0)
        good = out >= threshold
        return pa.RecordBatch.from_pydict({"doc_id": ids, "posterior": pa.array(posterior), "score": pa.array(out), "predicted": pa.array(good.astype(np.int32)), "kept": pa.array(good)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(_scan(work)), "doc_id long, posterior double, score double, predicted int, kept boolean")
