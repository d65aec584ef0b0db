"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, mapped, table, text_or_empty

#: Bounds of the labelled sample that the model is fitted on: documents and characters.
MAX_DOCS, MAX_CHARS = 12_000, 60_000_000
#: Features: prefixes of these lengths beside whole words; most kept, least share of toxic documents, toxic documents that hold one
#: (a twentieth of all of them, 2 at least, where there are fewer).
PREFIXES, MAX_FEATURES, LEAST_SHARE, LEAST_DOCS = (4, 5, 6), 20_000, 0.4, 4
#: Training: steps, rate, weight decay, bias to start from.
STEPS, RATE, DECAY, BIAS = 500, 0.15, 1e-4, -7.0
#: Calibration: folds of the training rows, the share of their clean documents that may be rejected out of fold, and the
#: range of the probability from which a document is rejected.
FOLDS, FALSE_ALARMS, CUTS = 5, 0.0075, (0.05, 0.5)
_SENTENCE = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> tuple[str, ...]:
    """A whole word and its prefixes (marked with ``*``)."""
    return (word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k))


@dataclass
class Model:
    """Weights of features and the bias of a sentence; ``prior`` is the score where nothing could be learnt, ``cut`` the noisy-or that scores 0.5."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -12.0
    prior: float | None = None
    cut: float = 0.5
    memo: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def word(self, word: str) -> float:
        w = self.memo.get(word)
        if w is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            get = self.weights.get
            w = self.memo[word] = sum(get(f, 0.0) for f in features(word))
        return w

    def sentences(self, text: str) -> list[tuple[str, float]]:
        """Each sentence that holds a word with its probability, to locate what offends."""
        out = []
        for s in _SENTENCE.split(text):
            if found := _WORD.findall(s.lower()):
                z = self.bias + sum(self.word(w) for w in set(found))
                out.append((s.strip(), float(1 / (1 + np.exp(-np.clip(z, -60, 60))))))
        return out

    def score(self, text: str) -> float:
        """Noisy-or of the sentences of a text (of one clean sentence if it has none), its log odds less those of ``cut``."""
        if self.prior is not None:
            return self.prior
        z, clean, word, memo = [], 0, self.word, self.memo.get
        for s in _SENTENCE.split(text.lower()):
            found = set(_WORD.findall(s))
            if not found:
                continue
            total = 0.0
            for w in found:
                m = memo(w)
                total += word(w) if m is None else m
            if total:
                z.append(total)
            else:
                clean += 1
        z = self.bias + np.array(z + [0.0] * (not z and not clean))
        log_clean = -np.logaddexp(0, z).sum() - clean * np.logaddexp(0, self.bias)
        return calibrated(float(-np.expm1(log_clean)), self.cut)


def calibrated(probability: float, cut: float) -> float:
    """A probability with its log odds moved so that ``cut`` becomes one half."""
    p = min(1.0, max(0.0, probability))
    return p if cut == 0.5 else p * (1 - cut) / (p * (1 - cut) + (1 - p) * cut)


class Sample:
    """Labelled documents as numbers: words of sentences, sentences of documents, features of words.

    Texts are kept as numbers of words, so memory follows the number of words rather than of strings.
    """

    def __init__(self, samples: Iterable[tuple[str, int]]):
        words: dict[str, int] = {}
        flat, sizes, counts, labels = array("i"), array("i"), array("i"), []
        for text, label in samples:
            count = 0
            for s in _SENTENCE.split(text.lower()):
                if found := set(_WORD.findall(s)):
                    flat.extend([words.setdefault(w, len(words)) for w in found])
                    sizes.append(len(found))
                    count += 1
            counts.append(count)
            labels.append(label)
        self.y = np.array(labels, dtype=float)
        self.flat = np.array(flat, dtype=np.int32)
        #: Sentence of each word, document of each sentence, sentences of each document.
        self.sentence = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        self.counts = np.array(counts, dtype=np.int64)
        self.words = list(words)
        del words
        # Features of each word, by number; -1 where a word is too short for a prefix. They are told apart by 64-bit
        # hashes, so that no string is held for each.
        self.table = np.full((len(self.words), 1 + len(PREFIXES)), -1, dtype=np.int32)
        hashes = np.zeros(self.table.shape, dtype=np.uint64)
        for k, w in enumerate(self.words):
            own = [xxhash.xxh64_intdigest(f) for f in features(w)]
            hashes[k, : len(own)] = own
        held = hashes != 0
        numbers = np.unique(hashes[held], return_inverse=True)
        self.features = len(numbers[0])
        self.table[held] = numbers[1]

    def names(self, chosen: np.ndarray) -> dict[str, int]:
        """Features by name, with their places in ``chosen``."""
        place = np.full(self.features + 1, -1, dtype=np.int32)
        place[chosen] = np.arange(len(chosen))
        rows = np.flatnonzero((place[self.table] >= 0).any(axis=1))
        return {f: int(place[n]) for k in rows.tolist() for f, n in zip(features(self.words[k]), self.table[k].tolist(), strict=False) if place[n] >= 0}

    def held_by(self, folds: int) -> tuple[np.ndarray, np.ndarray]:
        """How many documents of each fold hold each feature, and how many toxic ones."""
        every, bad = (np.zeros((folds, self.features), dtype=np.uint16 if len(self.y) < 1 << 16 else np.int32) for _ in range(2))
        bounds = np.searchsorted(self.owner[self.sentence], np.arange(len(self.y) + 1))
        for d in range(len(self.y)):
            own = np.unique(self.table[np.unique(self.flat[bounds[d] : bounds[d + 1]])])
            own = own[own >= 0]
            every[d % folds, own] += 1
            if self.y[d]:
                bad[d % folds, own] += 1
        return every, bad


class Fit:
    """The likelihood of document labels by the chosen features; documents whose ``use`` is 0 are carried but not learnt from."""

    def __init__(self, sample: Sample, chosen: np.ndarray, use: np.ndarray):
        place = np.full(sample.features + 1, -1, dtype=np.int32)
        place[chosen] = np.arange(len(chosen))
        held, item = [], []
        for c in range(sample.table.shape[1]):
            f = place[sample.table[sample.flat, c]]
            hit = np.flatnonzero(f >= 0)
            held.append(sample.sentence[hit])
            item.append(f[hit])
        # A feature counts in a sentence for each of its different words, as in a score.
        held, self.item = np.concatenate(held), np.concatenate(item)
        marked, self.held = np.unique(held, return_inverse=True)
        self.owner, self.docs = sample.owner[marked], len(sample.y)
        self.clean = sample.counts - np.bincount(self.owner, minlength=self.docs)
        self.y, self.use, self.size = sample.y, use.astype(float), len(chosen)
        self.share = np.bincount(self.item, minlength=self.size)

    def toxic(self, w: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
        """z of each sentence that holds a feature, and the noisy-or of each document."""
        z = b + np.bincount(self.held, weights=w[self.item], minlength=len(self.owner))
        log_clean = -np.bincount(self.owner, weights=np.logaddexp(0, z), minlength=self.docs) - self.clean * np.logaddexp(0, b)
        return z, np.clip(-np.expm1(log_clean), 1e-9, 1 - 1e-9)

    def loss(self, w: np.ndarray, b: float) -> float:
        _, toxic = self.toxic(w, b)
        likely = np.where(self.y > 0, np.log(toxic), np.log1p(-toxic))
        return float(-(self.use * likely).sum() / self.use.sum() + DECAY / 2 * (w * w).sum())

    def gradient(self, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        z, toxic = self.toxic(w, b)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
        # The negative log likelihood grows with a sentence's z by its p in a clean document, by -p (1 - P) / P in a toxic one.
        g = self.use * np.where(self.y > 0, -(1 - toxic) / toxic, 1.0)
        gz, n = p * g[self.owner], self.use.sum()
        return np.bincount(self.item, weights=gz[self.held], minlength=self.size) / n + DECAY * w, float((gz.sum() + (self.clean * g).sum() * p0) / n)

    def run(self, start: np.ndarray) -> tuple[np.ndarray, float]:
        """Weights and bias after ``STEPS`` steps by moments of the gradient."""
        x, m, v = np.append(start, BIAS), np.zeros(self.size + 1), np.zeros(self.size + 1)
        for step in range(1, STEPS + 1):
            grad = np.append(*self.gradient(x[:-1], x[-1]))
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            x = x - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        return x[:-1], float(x[-1])


def choose(every: np.ndarray, bad: np.ndarray, toxic: float, base: float) -> np.ndarray:
    """Features that hold enough evidence, the strongest first."""
    # One chance occurrence in a clean document is added to each, so that rare words need more evidence.
    share = bad / (every + 1)
    evidence = bad * np.log(np.maximum(share, 1e-9) / base)
    # Twice the base rate, or half the way from it to one where that is less: a share never reaches one.
    chosen = np.flatnonzero((share >= max(LEAST_SHARE, min(2 * base, (1 + base) / 2))) & (bad >= min(LEAST_DOCS, max(2, toxic / 20))))
    return chosen[np.argsort(-evidence[chosen], kind="stable")[:MAX_FEATURES]]


def _learnt(sample: Sample, every: np.ndarray, bad: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Chosen features, their weights, the bias and the noisy-or of all documents, learnt from those that ``use`` marks."""
    toxic = float(sample.y[use].sum())
    chosen = choose(every, bad, toxic, toxic / use.sum())
    fit_ = Fit(sample, chosen, use)
    # Training starts where a word's features share the log odds of the documents that hold them.
    odds = np.clip(np.log((bad[chosen] + 0.5) / (every[chosen] - bad[chosen] + 0.5)), -3, 5)
    known = np.isin(sample.table, chosen).sum(axis=1)[sample.flat]
    place = np.full(sample.features + 1, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    beside = np.zeros(len(chosen))
    for c in range(sample.table.shape[1]):
        f = place[sample.table[sample.flat, c]]
        hit = f >= 0
        beside += np.bincount(f[hit], weights=known[hit], minlength=len(chosen))
    w, b = fit_.run((odds - BIAS) / np.maximum(beside / np.maximum(fit_.share, 1), 1))
    return chosen, w, b, fit_.toxic(w, b)[1]


def cut_of(sample: Sample, every: np.ndarray, bad: np.ndarray) -> float:
    """The noisy-or from which a document is rejected: that of the best F-score out of fold, where recall counts twice as much as precision.

    It rejects no more than ``FALSE_ALARMS`` of the clean documents out of fold and stays within ``CUTS``; where none does, or there are too few
    documents for the folds, it is one half.
    """
    if sample.y.sum() < 4 * FOLDS or (1 - sample.y).sum() < 4 * FOLDS:
        return CUTS[1]
    out, fold = np.zeros(len(sample.y)), np.arange(len(sample.y)) % FOLDS
    for k in range(FOLDS):
        others = [j for j in range(FOLDS) if j != k]
        out[fold == k] = _learnt(sample, every[others].sum(axis=0, dtype=np.int64), bad[others].sum(axis=0, dtype=np.int64), fold != k)[3][fold == k]
    # Rejected documents from the highest noisy-or down; those of equal ones go together.
    order = np.argsort(-out, kind="stable")
    caught, alarms = np.cumsum(sample.y[order]), np.cumsum(1 - sample.y[order])
    able = np.append(np.diff(out[order]) < 0, True) & (out[order] >= CUTS[0]) & (out[order] <= CUTS[1]) & (alarms <= FALSE_ALARMS * (1 - sample.y).sum())
    if not able.any():
        return CUTS[1]
    worth = np.where(able, 5 * caught / (5 * caught + 4 * (sample.y.sum() - caught) + alarms), -1.0)
    return float(out[order][int(np.argmax(worth))])


def fit(samples: Iterable[tuple[str, int]]) -> Model:
    """Learns from (text, document label) alone; one class only gives its smoothed share as the score of every text."""
    sample = Sample(samples)
    y = sample.y
    if not len(y) or y.min() == y.max():
        return Model(prior=float((y.sum() + 0.5) / (len(y) + 2)) if len(y) else 0.0)
    every, bad = sample.held_by(FOLDS)
    cut = cut_of(sample, every, bad)
    chosen, w, b, _ = _learnt(sample, every.sum(axis=0, dtype=np.int64), bad.sum(axis=0, dtype=np.int64), np.ones(len(y), dtype=bool))
    return Model({f: float(w[k]) for f, k in sample.names(chosen).items()}, b, cut=cut)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 0 by 5; null ids count as training rows."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> Model:
    """Fits the model on labelled rows outside the held-out fifth.

    The sample is the first ``max_docs`` labelled ids in the order of a hash of the id, whole texts, without
    those that would pass ``max_chars``; both bounds hold what the driver takes. Of repeated rows of an id one
    counts (the greatest text, the toxic label).
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("lid"), F.col("toxic").cast("int").alias("toxic")).where("lid is not null and toxic in (0, 1)")
    ids = ids.where(~held_out(F.col("lid"))).groupBy("lid").agg(F.max("toxic").alias("toxic"))
    ids = checkpointed(ids.orderBy(F.xxhash64("lid", F.lit(9)), "lid").limit(max_docs))
    texts = docs.select(F.col("doc_id").cast("long").alias("own_id"), text_or_empty().alias("text"))
    found = texts.join(F.broadcast(ids), texts.own_id == ids.lid).select("lid", "toxic", "text")
    sample = found.groupBy("lid", "toxic").agg(F.max("text").alias("text")).orderBy(F.xxhash64("lid", F.lit(9)), "lid")

    def bounded() -> Iterator[tuple[str, int]]:
        held = 0
        for row in sample.toLocalIterator():
            if held + len(row["text"]) <= max_chars:
                held += len(row["text"])
                yield row["text"], row["toxic"]

    return fit(bounded())


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text, empty and null ones too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            scores = pa.array([own.score(t) for t in b.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), scores], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return mapped(rows, run, "doc_id long, score double")


def offending(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, sentence_no, sentence, score) of sentences whose own probability is at least ``least``: where a document offends.

    A sentence's probability is its own, before the calibration of documents; sentence_no counts sentences with a word from 0. Of a document that only the noisy-or of several sentences
    rejects, its worst sentence is given, with its lower score; documents that are not rejected have no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            out: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if own.prior is not None or own.score(text) < 0.5:
                    continue
                found = [(doc_id, k, s, p) for k, (s, p) in enumerate(own.sentences(text))]
                worst = max((f[3] for f in found), default=0.0)
                out += [f for f in found if f[3] >= min(least, worst)]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.string(), pa.float64()))], names=["doc_id", "sentence_no", "sentence", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return mapped(rows, run, "doc_id long, sentence_no int, sentence string, score double")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; repeated rows give repeated rows.

    Null texts score as empty ones. Labels of held-out rows and every column but the text are never used for a score.
    """
    s = scored(docs, train(docs, labels))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those whose score is 0.5 or more.

    Every column stays as it is, whatever its name; null texts count as empty and stay null, repeated rows stay or go
    together, long texts are scored whole. Labels of ids that are not in ``docs`` say nothing; without labels all stay. An empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            keep = [own.score(t or "") < 0.5 for t in texts.to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return mapped(docs, run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
