"""Document quality by a linear-chain conditional random field over lines: every line is good or bad, by its own features and those of its neighbours."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, mapped, table, text_or_empty

#: Bounds of the labelled sample that the model is fitted on: documents and lines. What the driver holds of a line is a byte for each feature.
MAX_DOCS, MAX_LINES = 12_000, 1_000_000
#: Lines of a training chain at most; a longer document is several chains, none of its lines is left out.
CHAIN = 128
#: Training: steps by the features of lines alone, then of the whole chain in rounds before which lines are labelled anew; rate and weight decay.
ALONE, ROUNDS, RATE, DECAY = 100, (200, 200), 0.1, 3e-5
#: A line of a bad document counts as bad in later rounds from this probability on, and so do its worst lines up to this share of its length.
BAD, SHARE = 0.5, 0.5

# What a byte of UTF-8 is: upper and lower case letters, digits, blanks, ends of sentences, marks within them, exclamations, other symbols; letters beyond ASCII.
_KINDS = {"A": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "a": b"abcdefghijklmnopqrstuvwxyz", "0": b"0123456789", " ": b" \t\r\f\v", ".": b".", ",": b",;:'\"()-", "!": b"!?"}
_CLASSES = bytes(next((ord(k) for k, bs in _KINDS.items() if c in bs), ord("x") if c >= 128 else ord("#")) for c in range(256))

#: Features of a line and the bounds of their bins.
FEATURES: dict[str, tuple[float, ...]] = {
    "symbols": (0.001, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4),
    "upper": (0.01, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8),
    "exclaimed": (0.001, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4),
    "digits": (0.001, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6),
    "stops": (0.001, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5),
    "distinct": (0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95),
    "adjacent": (0.001, 0.02, 0.05, 0.1, 0.25, 0.5, 0.8),
    "word_length": (1.5, 2.5, 3.5, 4.5, 5.5, 7.0, 10.0),
    "words": (1, 2, 4, 8, 16, 64, 256),
    "closed": (0.5,),
    "seen": (0.5,),
}
#: Bins of each feature, one more for what lies beyond the first or last line.
BINS = 9
EDGE = BINS - 1


def measures(text: str) -> tuple[list[tuple[float, ...]], list[int]]:
    """What ``FEATURES`` says of each line, and its weight: the bytes of the line with its end. An empty text is one empty line."""
    rows, weights, seen = [], [], set()
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        kinds, words = line.translate(_CLASSES), line.split()
        n, count = max(1, len(line)), len(words)
        upper, lower = kinds.count(b"A"), kinds.count(b"a")
        blank = kinds.count(b" ")
        repeats = sum(map(eq, words, words[1:])) if count > 1 else 0
        rows.append((
            kinds.count(b"#") / n, upper / max(1, upper + lower), kinds.count(b"!") / n, kinds.count(b"0") / n, kinds.count(b".") / n,
            len(set(words)) / count if count else 1.0, repeats / max(1, count - 1), (len(line) - blank) / max(1, count), count,
            float(kinds[-1:] in (b".", b"!")), float(line in seen),
        ))
        weights.append(len(line) + 1)
        if line:
            seen.add(line)
    return rows, weights


def binned(rows: list[tuple[float, ...]]) -> np.ndarray:
    """The bin of each feature of each line, a byte each."""
    values = np.array(rows, dtype=float).reshape(-1, len(FEATURES))
    return np.stack([np.searchsorted(b, values[:, k], side="right") for k, b in enumerate(FEATURES.values())], axis=1).astype(np.uint8)


def places(bins: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Numbers of the weights of each line: those of its bins, of the line before and of the line after it. ``firsts`` marks the first line of each document."""
    n, g = bins.shape
    before, after = np.full_like(bins, EDGE), np.full_like(bins, EDGE)
    before[1:], after[:-1] = bins[:-1], bins[1:]
    before[firsts] = EDGE
    after[np.append(firsts[1:], True)] = EDGE
    own = np.arange(g) * BINS
    return np.concatenate([bins + own, before + (own + g * BINS), after + (own + 2 * g * BINS)], axis=1).astype(np.int32) if n else np.zeros((0, 3 * g), dtype=np.int32)


#: Weights of a model.
SIZE = 3 * len(FEATURES) * BINS


class Chains:
    """Lines of training chains, laid out by their place in the chain so that all chains take a step at once."""

    def __init__(self, bins: np.ndarray, counts: np.ndarray):
        #: ``counts`` are the lines of each document.
        firsts = np.zeros(len(bins), dtype=bool)
        firsts[np.cumsum(counts) - counts] = True
        self.features = places(bins, firsts)
        starts = np.concatenate([np.arange(s, s + c, CHAIN) for s, c in zip(np.cumsum(counts) - counts, counts, strict=True)])
        ends = np.minimum(starts + CHAIN, np.repeat(np.cumsum(counts), -(-counts // CHAIN)))
        order = np.argsort(-(ends - starts), kind="stable")
        starts, sizes = starts[order], (ends - starts)[order]
        self.active = [int((sizes > t).sum()) for t in range(int(sizes.max()))]
        self.lines = np.concatenate([starts[:k] + t for t, k in enumerate(self.active)])
        self.at = np.append(0, np.cumsum(self.active))

    def passes(self, w: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(bad) of every line, expected pairs of labels, and the log partition function of all chains, by forward and backward passes."""
        z = w[self.features].sum(axis=1)[self.lines]
        top = np.maximum(z, 0)
        e = np.stack([np.exp(-top), np.exp(z - top)], axis=1)
        t, total = np.exp(a), float(top.sum())
        forward, scale = np.empty_like(e), np.empty(len(e))
        for k, n in enumerate(self.active):
            own = slice(self.at[k], self.at[k] + n)
            u = e[own] * (0.5 if k == 0 else forward[self.at[k - 1] : self.at[k - 1] + n] @ t)
            scale[own] = u.sum(axis=1)
            forward[own] = u / scale[own, None]
        total += float(np.log(scale).sum())
        backward, pairs = np.ones_like(e), np.zeros((2, 2))
        for k in range(len(self.active) - 1, 0, -1):
            n = self.active[k]
            own, before = slice(self.at[k], self.at[k] + n), slice(self.at[k - 1], self.at[k - 1] + n)
            later = e[own] * backward[own] / scale[own, None]
            backward[before] = later @ t.T
            pairs += (forward[before].T @ later) * t
        bad = np.empty(len(e))
        bad[self.lines] = (forward * backward)[:, 1]
        return bad, pairs, total

    def gradient(self, w: np.ndarray, a: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The mean negative log likelihood of the labels ``y`` of lines, and its gradients by features and by pairs."""
        bad, pairs, total = self.passes(w, a)
        own, n = y[self.lines], len(y)
        held = np.zeros((2, 2))
        for k in range(1, len(self.active)):
            now, before = own[self.at[k] : self.at[k] + self.active[k]], own[self.at[k - 1] : self.at[k - 1] + self.active[k]]
            held += np.bincount(before * 2 + now, minlength=4).reshape(2, 2)
        score = float((w[self.features].sum(axis=1) * y).sum() + (held * a).sum() + len(self.lines[: self.active[0]]) * np.log(0.5))
        by_feature = np.bincount(self.features.ravel(), weights=np.repeat(bad - y, self.features.shape[1]), minlength=SIZE)
        return (total - score) / n + DECAY / 2 * float((w * w).sum()), by_feature / n + DECAY * w, (pairs - held) / n

    def learn(self, w: np.ndarray, a: np.ndarray, y: np.ndarray, steps: int, alone: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Weights after so many steps by moments of the gradient; ``alone`` leaves those of neighbours and pairs as they are."""
        x, m, v = np.append(w, a.ravel()), np.zeros(SIZE + 4), np.zeros(SIZE + 4)
        for step in range(1, steps + 1):
            _, gw, ga = self.gradient(x[:SIZE], x[SIZE:].reshape(2, 2), y)
            g = np.append(gw, ga.ravel())
            if alone:
                g[SIZE // 3 :] = 0
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            x = x - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        return x[:SIZE], x[SIZE:].reshape(2, 2)


@dataclass
class Model:
    """Weights of features and of pairs of labels, and the line by which a document's log odds become its score; ``prior`` where nothing could be learnt."""

    weights: np.ndarray
    pairs: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    prior: float | None = None

    def lines(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(P(bad), weight) of every line of each text, by the forward and the backward pass over the whole text."""
        rows, weights, counts = [], [], []
        for t in texts:
            own, w = measures(t)
            rows += own
            weights += w
            counts.append(len(own))
        ends = np.cumsum(counts)
        firsts = np.zeros(len(rows), dtype=bool)
        firsts[ends - counts] = True
        z = self.weights[places(binned(rows), firsts)].sum(axis=1)
        odds, sizes = np.exp(np.clip(z, -60, 60)).tolist(), np.array(weights, dtype=float)
        return [(_marginals(odds[e - n : e], self.pairs), sizes[e - n : e]) for n, e in zip(counts, ends.tolist(), strict=True)]

    def scores(self, texts: list[str]) -> list[float]:
        """How likely each text is good: the marginals of its lines weighted by their length, calibrated."""
        if self.prior is not None:
            return [self.prior] * len(texts)
        return [_logistic(self.slope * aggregate(p, w) + self.offset) for p, w in self.lines(texts)]


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -60, 60))))


def _marginals(odds: list[float], pairs: np.ndarray) -> np.ndarray:
    """P(bad) of each line of one chain, from the odds by its features. Messages are scaled to one, so that a chain may have any length."""
    (gg, gb), (bg, bb) = np.exp(pairs).tolist()
    forward, p = [], 0.0
    for k, e in enumerate(odds):
        bad, good = (e, 1.0) if k == 0 else (((1 - p) * gb + p * bb) * e, (1 - p) * gg + p * bg)
        p = bad / (bad + good)
        forward.append(p)
    out, g, b = forward, 0.5, 0.5
    for k in range(len(odds) - 1, -1, -1):
        p = forward[k]
        p = p * b / (p * b + (1 - p) * g)
        e = odds[k]
        g, b = gg * g + gb * e * b, bg * g + bb * e * b
        g, b = g / (g + b), b / (g + b)
        out[k] = p
    return np.array(out)


def aggregate(bad: np.ndarray, sizes: np.ndarray) -> float:
    """Log odds of the share of a document that is good, each line by its length."""
    share = float(((1 - bad) * sizes).sum() / sizes.sum())
    share = min(max(share, 1e-4), 1 - 1e-4)
    return float(np.log(share / (1 - share)))


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic regression of labels on log odds, by Newton steps with a small ridge; the slope is never negative."""
    at, design = np.array([1.0, 0.0]), np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        gradient = design.T @ (p - y) + 0.1 * (at - [1.0, 0.0])
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        at = at - step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
    return max(0.0, float(at[0])), float(at[1])


def relabelled(bad: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which lines count as bad in a bad document: by their probability, and the worst of each document until they make up ``SHARE`` of its length."""
    owner, starts = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
    order = np.lexsort((-bad, owner))
    before = np.cumsum(sizes[order]) - sizes[order]
    before -= np.repeat(before[starts], counts)
    needed = np.empty(len(bad), dtype=bool)
    needed[order] = before < SHARE * np.repeat(np.add.reduceat(sizes, starts), counts)
    return needed | (bad >= BAD)


def fit(sample: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """Learns from (label, bins of lines, weights of lines) of documents.

    At first every line has the label of its document and is judged by its own features alone. Then, before each round of the whole chain, lines of bad
    documents that the model finds good count as good, so that a bad document may hold good lines. One class only, or none, gives its smoothed share as the score of every text.
    """
    rows = list(sample)
    y = np.array([label for label, _, _ in rows], dtype=int)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(SIZE), np.zeros((2, 2)), prior=float((y.sum() + 0.5) / (len(y) + 1)))
    counts = np.array([len(b) for _, b, _ in rows], dtype=np.int64)
    chains = Chains(np.concatenate([b for _, b, _ in rows]), counts)
    starts = np.cumsum(counts) - counts
    label, sizes = np.repeat(1 - y, counts), np.concatenate([s for _, _, s in rows])
    w, a = chains.learn(np.zeros(SIZE), np.zeros((2, 2)), label, ALONE, alone=True)
    for steps in ROUNDS:
        w, a = chains.learn(w, a, label * relabelled(chains.passes(w, a)[0], sizes, counts), steps)
    model = Model(w, a)
    z = np.exp(np.clip(w[chains.features].sum(axis=1), -60, 60)).tolist()
    x = np.array([aggregate(_marginals(z[s : s + n], a), own) for s, n, (_, _, own) in zip(starts.tolist(), counts.tolist(), rows, strict=True)])
    model.slope, model.offset = calibrate(x, y.astype(float))
    return model


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 1 by 3; null ids count as training rows."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES) -> Model:
    """Fits the model on labelled rows outside the held-out third.

    The sample is the first ``max_docs`` labelled ids in the order of a hash of the id, all lines of each, without those that would pass
    ``max_lines``. Lines are measured in tasks; the driver takes their bins only. Of repeated rows of an id one counts (the greatest text, the lower quality).
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("lid"), F.col("quality").cast("int").alias("quality")).where("lid is not null and quality in (0, 1)")
    ids = ids.where(~held_out(F.col("lid"))).groupBy("lid").agg(F.min("quality").alias("quality"))
    ids = checkpointed(ids.orderBy(F.xxhash64("lid", F.lit(11)), "lid").limit(max_docs))
    texts = docs.select(F.col("doc_id").cast("long").alias("own_id"), text_or_empty().alias("text"))
    found = texts.join(F.broadcast(ids), texts.own_id == ids.lid).groupBy("lid", "quality").agg(F.max("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for lid, quality, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, sizes = measures(text)
                out.append((lid, quality, binned(rows).tobytes(), np.array(sizes, dtype="<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["lid", "quality", "bins", "sizes"])

    measured = mapped(found, run, "lid long, quality int, bins binary, sizes binary").orderBy(F.xxhash64("lid", F.lit(11)), "lid")

    def bounded() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        held = 0
        for row in measured.toLocalIterator():
            sizes = np.frombuffer(row["sizes"], dtype="<i8")
            if held + len(sizes) <= max_lines:
                held += len(sizes)
                yield row["quality"], np.frombuffer(row["bins"], dtype=np.uint8).reshape(-1, len(FEATURES)), sizes

    return fit(bounded())


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text, empty and null ones too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(b.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return mapped(rows, run, "doc_id long, score double")


def labelled_lines(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, line_no, bad, probability) of every line of every text: where a document is bad, and by which line it is."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [p for p, _ in shared.value.lines(b.column(1).to_pylist())] if b.num_rows else []
            sizes = [len(p) for p in found]
            p = np.concatenate(found) if found else np.zeros(0)
            numbers = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]) if found else np.zeros(0, dtype=np.int32)
            owner = b.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays([owner, pa.array(numbers), pa.array(p >= BAD), pa.array(p)], names=["doc_id", "line_no", "bad", "probability"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return mapped(rows, run, "doc_id long, line_no int, bad boolean, probability double")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; repeated rows give repeated rows.

    Null texts score as empty ones, which are one empty line; texts are read whole, however long. Labels of held-out rows and every column but the text are
    never used for a score; other columns are not read. Labels of ids that are not in ``docs`` say nothing; without labels all score one half. An empty table
    gives no rows.
    """
    s = scored(docs, train(docs, labels))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
