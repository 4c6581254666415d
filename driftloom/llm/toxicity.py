"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A linear scorer over a sentence's words gives the probability p that the sentence is
toxic: 1 - p = (1 - s(x - BAR)) / (1 - s(-BAR)) with the logistic s and the sum x of its words' weights, so a sentence of unknown
words has p = 0. The document's probability is their noisy-or, 1 - prod(1 - p). Only documents are labelled: the likelihood of the labels is
raised by Adam through the noisy-or, so blame goes to the sentences that explain the label. The fitted scorer then
tells which sentences are offending.

A word (a run of letters; A-Z lower-cased, all bytes of other characters count as letters) has as features itself and its
first 4 to 8 bytes, so inflected and compound forms of a learnt stem count too. Features are told apart by 64-bit hashes
and kept as a sorted array that is looked up exactly: unknown words never share a weight with learnt ones. A feature takes part
if it occurs in ``LEAST_DOCS`` documents and in ``LEAST_EVIDENCE`` more toxic ones than their share of all; an L1 penalty leaves those without a
weight that add less evidence than ``LEAST_EVIDENCE`` documents. Weights are not negative: no context excuses a toxic word.

Near copies count once: a document of the fit weighs 1 / (documents of its group), where groups are joined by at least
``AGREE`` of ``MINHASHES`` equal min-hashes of their words.

The fit uses a documented bounded sample: the ``SAMPLE`` labelled documents with the smallest md5 of their id, each with all of
its words. Scoring covers every whole text.

Defined results: null counts as empty; a text without words scores 0; labels or ids that are null are not learnt from (a row with
a null id is scored like any other and counts as not held out), and of several labels of one id the highest counts;
without two classes of labels every score is 0; repeated rows score alike, and no ties arise; a very long text is scored
in one piece, in memory of its own size; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialise
from .textarrays import byte_table, hash_sums, mix, run_hashes, runs, spans_of, tidy, utf8

SAMPLE = 8000
#: A feature must occur in so many documents of the sample, near copies counted once.
LEAST_DOCS = 3
#: Bytes of a word's beginnings that are features beside the word.
STEMS = (4, 5, 6, 7, 8)
MINHASHES, AGREE, BAND = 16, 8, 2
#: Bytes of text that are worked on at once.
PART = 1 << 19
#: Weight that a sentence needs to be as likely toxic as not.
BAR = 4.0
#: Evidence, in documents, that a feature must add to get a weight at all (an L1 penalty), and the L2 penalty.
LEAST_EVIDENCE, DECAY = 1.0, 1e-5
#: Steps, their length, at which of them features are reviewed; at the last those without a weight go, and the penalty ends.
STEPS, RATE, REVIEWS = 300, 0.2, (10, 20, 40, 80, 140, 220)

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
STOP = np.zeros(256, np.int64)
STOP[[ord("."), ord("!"), ord("?"), 10, 13]] = 1
TABLE = byte_table(seed=77)


def held_out(id_col: str) -> Column:
    """Rows that no label is learnt from; never a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bag(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of bytes: each word's features (a row of hashes; 0: none), its start, its sentence; and each row's first word.

    Sentences are numbered across rows.
    """
    starts, ends = spans_of(LETTER[data], at)
    first = np.searchsorted(starts, at)
    stops = np.concatenate([[0], np.cumsum(STOP[data])])
    edge = np.zeros(len(data) + 1, np.int64)
    edge[at[1:-1]] = 1  # a row's start is a sentence's start; empty rows add nothing
    found = np.zeros((len(starts), 1 + len(STEMS)), np.uint64)
    sums = hash_sums(data, TABLE)
    found[:, 0] = run_hashes(data, starts, ends, TABLE, sums)
    for k, size in enumerate(STEMS, 1):
        some = np.flatnonzero(ends - starts > size)
        found[some, k] = mix(run_hashes(data, starts[some], starts[some] + size, TABLE, sums) + np.uint64(k))
    return found, starts, (stops[starts] + np.cumsum(edge)[starts] if len(starts) else starts), first


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def blame(x: np.ndarray) -> np.ndarray:
    """-log(1 - p) of sentences whose weights sum to ``x``."""
    return np.maximum(_softplus(x - BAR) - _softplus(np.array(-BAR)), 0)


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes and their weights."""

    words: np.ndarray
    weights: np.ndarray

    def lookup(self) -> np.ndarray:
        """For each value of a hash's upper 22 bits, is any feature there? Most words end here."""
        out = np.zeros(1 << 22, bool)
        out[(self.words >> np.uint64(42)).astype(np.int64)] = True
        return out

    def of_sentences(self, found: np.ndarray, heads: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Summed weights of each sentence's distinct features; ``heads``: each sentence's first word."""
        word, kind = np.nonzero(near[(found >> np.uint64(42)).astype(np.int64)])
        if not len(word) or not len(self.words):
            return np.zeros(len(heads))
        some = found[word, kind]
        place = np.minimum(np.searchsorted(self.words, some), len(self.words) - 1)
        hit = self.words[place] == some
        where = np.searchsorted(heads, word[hit], side="right") - 1
        pairs = np.unique(where.astype(np.int64) << np.int64(32) | place[hit])
        return np.bincount(pairs >> 32, weights=self.weights[pairs & 0xFFFFFFFF], minlength=len(heads))


NOTHING = Model(np.zeros(0, np.uint64), np.zeros(0))


def copy_weights(least: np.ndarray) -> np.ndarray:
    """1 / (documents of the group) of each row of min-hashes; a group's rows agree with its first in ``AGREE`` places or more.

    Candidates share a band of ``BAND`` min-hashes; each is held against the first row of the band.
    """
    n = len(least)
    label = np.arange(n)
    for k in range(0, MINHASHES, BAND):
        band = least[:, k].copy()
        for j in range(k + 1, k + BAND):
            band = mix(band + mix(least[:, j]))
        order = np.argsort(band, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], band[order][1:] != band[order][:-1]]))
        lead = np.empty(n, np.int64)
        lead[order] = np.repeat(order[head], np.diff(np.append(head, n)))
        near = np.flatnonzero((least == least[lead]).sum(1) >= AGREE)
        while True:  # the smaller of both labels, until nothing changes
            low = np.minimum(label[near], label[lead[near]])
            if (label[near] == low).all() and (label[lead[near]] == low).all():
                break
            np.minimum.at(label, near, low)
            np.minimum.at(label, lead[near], low)
    return 1.0 / np.bincount(label, minlength=n)[label]


def train(vocab: np.ndarray, which: np.ndarray, sentence: np.ndarray, owner: np.ndarray, labels: np.ndarray, weight: np.ndarray | None = None) -> Model:
    """Fit by Adam: each found feature ``which`` of the vocabulary with its ``sentence``; ``owner``: each sentence's document.

    Labels may be wrong: the noisy-or has a leak, a probability of the label without any toxic sentence, that is fitted too
    and is no part of a score.
    """
    if not len(labels) or labels.min() == labels.max() or not len(vocab):
        return NOTHING
    y = labels.astype(float)
    share = np.ones(len(y)) if weight is None else weight
    least = LEAST_EVIDENCE / share.sum()
    share = share / share.sum()
    all_which, all_sentence = which.astype(np.int64), sentence.astype(np.int64)
    w, m, v = np.zeros(len(vocab)), np.zeros(len(vocab) + 1), np.zeros(len(vocab) + 1)
    leak, live, which, sentence, doc = -3.0, np.arange(len(vocab)), all_which, all_sentence, owner

    def pulled(x: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, float]:
        """Gradient by sentence and of the leak; sentences left out have no weight and so no blame."""
        clean = np.bincount(doc, weights=blame(x), minlength=len(y)) + _softplus(np.array(leak))  # -log P(label 0)
        pull = share * np.where(y > 0, -np.exp(-clean) / -np.expm1(-clean), 1.0)
        return pull[doc] / (1 + np.exp(BAR - x)), pull.sum() / (1 + np.exp(-leak))

    for step in range(1, STEPS + 1):
        if step in REVIEWS:  # features without weight whose gradient is well below the penalty rest until the next review
            g, _ = pulled(np.bincount(all_sentence, weights=w[all_which], minlength=len(owner)), owner)
            keep = (w > 0) if step == REVIEWS[-1] else (w > 0) | (-np.bincount(all_which, weights=g[all_sentence], minlength=len(vocab)) > 0.7 * least)
            live, some = np.flatnonzero(keep), keep[all_which]
            which = (np.cumsum(keep) - 1)[all_which[some]]
            held, sentence = np.unique(all_sentence[some], return_inverse=True)
            doc = owner[held]
        g, of_leak = pulled(np.bincount(sentence, weights=w[live][which], minlength=len(doc)), doc)
        both = np.append(live, len(vocab))
        grad = np.append(np.bincount(which, weights=g[sentence], minlength=len(live)) + DECAY * w[live], of_leak)
        m[both], v[both] = 0.9 * m[both] + 0.1 * grad, 0.99 * v[both] + 0.01 * grad * grad
        rate = RATE * (1 - step / (STEPS + 1)) / (np.sqrt(v[both] / (1 - 0.99**step)) + 1e-6)
        move = rate * m[both] / (1 - 0.9**step)
        leak -= move[-1]
        new = w[live] - move[:-1]
        w[live] = np.maximum(new - rate[:-1] * least * (step < REVIEWS[-1]), 0)
    some = w > 0
    return Model(vocab[some], w[some])


def _by_row(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows (id, label, text): id, label, the words' features and sentences."""
    for batch in batches:
        data, at = utf8(batch.column(1))
        ids, marks = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        for i, j in runs(at, PART):
            found, _, sentence, first = bag(data[at[i] : at[j]], at[i : j + 1] - at[i])
            for k in range(j - i):
                yield int(ids[i + k]), int(marks[i + k]), found[first[k] : first[k + 1]], sentence[first[k] : first[k + 1]]


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Min-hashes of each document's words."""
    for doc, label, found, _ in _by_row(batches):
        words = np.unique(found[:, 0])
        salts = mix(np.arange(1, MINHASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        least = np.array([mix(words ^ salt).min() for salt in salts]) if len(words) else mix(salts + np.uint64(doc % (1 << 64)))
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc], pa.int64()), "label": pa.array([label], pa.int32()), "least": pa.array([least.tobytes()], pa.binary())})


def _counted(weights: dict[int, float]):
    """Features with how many documents hold them and how many toxic ones, near copies counted once; summed by task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rate: list[tuple[float, float]] = []

        def flush() -> pa.RecordBatch:
            sizes = [len(x) for x in held]
            names, inverse = np.unique(np.concatenate(held), return_inverse=True)
            both = np.repeat(np.array(rate), sizes, axis=0)
            docs, toxic = (np.bincount(inverse, weights=both[:, k], minlength=len(names)) for k in (0, 1))
            held.clear()
            rate.clear()
            return pa.RecordBatch.from_pydict({"feature": pa.array(names.view(np.int64)), "docs": pa.array(docs), "toxic": pa.array(toxic)})

        for doc, label, found, _ in _by_row(batches):
            names = np.unique(found)
            held.append(names[names > 0])
            rate.append((weights[doc], weights[doc] * (label > 0)))
            if sum(map(len, held)) > 1 << 20:
                yield flush()
        if held:
            yield flush()

    return run


def _places(vocab: np.ndarray):
    """Documents with the places of vocabulary features, and the sentence of each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, label, found, sentence in _by_row(batches):
            _, rel = np.unique(sentence, return_inverse=True)
            place = np.minimum(np.searchsorted(vocab, found), max(len(vocab) - 1, 0))
            hit = vocab[place] == found if len(vocab) else np.zeros(found.shape, bool)
            pairs = np.unique(np.repeat(rel, hit.sum(1)) << np.int64(32) | place[hit])  # a feature counts once in a sentence
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([doc], pa.int64()), "label": pa.array([label], pa.int32()), "n": pa.array([int(rel.max()) + 1 if len(rel) else 0], pa.int32()),
                "places": pa.array([(pairs & 0xFFFFFFFF).astype("<i4").tobytes()], pa.binary()), "sentence": pa.array([(pairs >> 32).astype("<i4").tobytes()], pa.binary()),
            })

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, owner: str = "query") -> Model:
    """A model from the labelled documents (the bounded sample of the module's docstring), which are written once and read thrice.

    The driver gets min-hashes, the features that take part, and those features' places, but no text.
    """
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .dropna()
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
        .limit(sample)
    )
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers
    rows = materialise(rows.select("doc_id", "text", "label"), owner)
    seen = rows.mapInArrow(tidy(_signatures), "doc_id long, label int, least binary").toArrow()
    if not seen.num_rows:
        return NOTHING
    seen = seen.sort_by([("doc_id", "ascending"), ("least", "ascending")])
    weight = copy_weights(np.frombuffer(b"".join(seen["least"].to_pylist()), np.uint64).reshape(-1, MINHASHES))
    ids, marks = seen["doc_id"].to_numpy(), seen["label"].to_numpy() > 0
    base = float((weight * marks).sum() / weight.sum())
    weights = dict(zip(ids.tolist(), weight.tolist(), strict=True))
    counted = rows.mapInArrow(tidy(_counted(weights)), "feature long, docs double, toxic double").groupBy("feature").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    vocab = counted.filter((F.col("docs") > LEAST_DOCS - 0.5) & (F.col("toxic") > F.col("docs") * base + LEAST_EVIDENCE)).select("feature").toArrow()["feature"].to_numpy()
    vocab = np.sort(vocab.view(np.uint64))
    found = rows.mapInArrow(tidy(_places(vocab)), "doc_id long, label int, n int, places binary, sentence binary").toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("places", "ascending"), ("sentence", "ascending")])
    marks = (found["label"].to_numpy() > 0).astype(int)
    counts = found["n"].to_numpy().astype(np.int64)
    ahead = np.cumsum(counts) - counts
    which = np.concatenate([np.frombuffer(x.as_py(), "<i4") for x in found["places"]])
    sentence = np.concatenate([np.frombuffer(x.as_py(), "<i4") + b.astype(np.int32) for x, b in zip(found["sentence"], ahead, strict=True)])
    weight = np.array([weights[x] for x in found["doc_id"].to_pylist()])
    del found
    return train(vocab, which, sentence, np.repeat(np.arange(len(counts)), counts), marks, weight)


def _judged(model: Model):
    """Scores and offending sentences of the rows of a string column."""
    near = model.lookup()

    def judge(column: pa.Array) -> tuple[np.ndarray, list[str]]:
        data, at = utf8(column)
        scores, places = np.zeros(len(column)), [""] * len(column)
        for i, j in runs(at, PART):
            part, rel = data[at[i] : at[j]], at[i : j + 1] - at[i]
            found, starts, sentence, first = bag(part, rel)
            if not len(found):
                continue
            heads = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
            x = model.of_sentences(found, heads, near)
            clean = np.concatenate([[0.0], np.cumsum(blame(x))])
            mine = np.searchsorted(heads, first)  # each row's first sentence
            scores[i:j] = -np.expm1(-np.maximum(clean[mine[1:]] - clean[mine[:-1]], 0))
            bad = np.flatnonzero(blame(x) >= np.log(2))
            if not len(bad):
                continue
            points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])  # code points before each byte
            stops = np.append(np.flatnonzero(STOP[part]) + 1, len(part))
            begin = starts[heads[bad]]
            row = np.searchsorted(rel, begin, side="right") - 1
            end = np.minimum(stops[np.searchsorted(stops, begin, side="right")], rel[row + 1])
            for k in np.unique(row):
                some = row == k
                lead = points[rel[k]]
                places[i + k] = ",".join(f"{a}:{e}" for a, e in zip((points[begin[some]] - lead).tolist(), (points[end[some]] - lead).tolist(), strict=True))
        return scores, places

    return judge


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, offending: the last lists sentences with p >= 0.5 as start:end in code points."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judged(model)
        for batch in batches:
            scores, places = judge(batch.column(1))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(scores), "predicted": pa.array((scores >= 0.5).astype(np.int32)), "offending": pa.array(places, pa.string())})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, score double, predicted int, offending string")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns, in one pass without a shuffle."""
    place = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judged(model)
        for batch in batches:
            yield batch.filter(pa.array(judge(batch.column(place))[0] < 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)
