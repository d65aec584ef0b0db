"""The fit of the toxicity model against plain loops, its recall on held-out rows, and the filter on odd tables."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_rest import corpus

from spindrift.llm import toxicity as T


def fitted(n=160, seed=5):
    rows, labels = corpus(n, seed)
    samples = [(t, lab[2]) for (_, t), lab in zip(rows, labels, strict=True)] + [("", 0), ("!", 1), ("vilest", 1)]
    sample = T.Sample(samples)
    every, bad = sample.held_by(3)
    chosen = T.choose(every.sum(axis=0, dtype=int), bad.sum(axis=0, dtype=int), sample.y.sum(), sample.y.mean())
    use = np.arange(len(samples)) % 4 != 0
    return samples, sample, chosen, use, T.Fit(sample, chosen, use)


def plain_loss(samples, names, use, w, b):
    """Document by document, sentence by sentence, word by word."""
    total = 0.0
    for (text, label), u in zip(samples, use, strict=True):
        if not u:
            continue
        clean = 1.0
        for s in T._SENTENCE.split(text.lower()):
            words = set(T._WORD.findall(s))
            if words:
                z = b + sum(w[names[f]] for x in words for f in T.features(x) if f in names)
                clean *= 1 - 1 / (1 + math.exp(-z))
        p = min(max(1 - clean, 1e-9), 1 - 1e-9)
        total -= math.log(p) if label else math.log(1 - p)
    return total / use.sum() + T.DECAY / 2 * (w * w).sum()


def test_loss_and_gradient():
    samples, sample, chosen, use, fit = fitted()
    r = np.random.default_rng(2)
    w, b = r.normal(size=len(chosen)), -2.0
    names = sample.names(chosen)
    assert fit.loss(w, b) == pytest.approx(plain_loss(samples, names, use, w, b), rel=1e-9)
    gw, gb = fit.gradient(w, b)
    h = 1e-6
    for k in range(len(chosen)):
        step = np.zeros(len(w))
        step[k] = h
        assert abs((fit.loss(w + step, b) - fit.loss(w - step, b)) / (2 * h) - gw[k]) < 1e-6
    assert abs((fit.loss(w, b + h) - fit.loss(w, b - h)) / (2 * h) - gb) < 1e-6


def test_counts_of_features():
    samples, sample, *_ = fitted()
    every, bad = (x.sum(axis=0, dtype=int) for x in sample.held_by(3))
    numbers = sample.names(np.arange(sample.features))
    for f in ("vilest", "scum*", "word"):
        holds = [any(f in T.features(w) for w in T._WORD.findall(t.lower())) for t, _ in samples]
        assert every[numbers[f]] == sum(holds) and bad[numbers[f]] == sum(h for h, (_, y) in zip(holds, samples, strict=True) if y)


def test_training_lowers_the_loss():
    _, _, chosen, _, fit = fitted()
    w, b = fit.run(np.zeros(len(chosen)))
    gw, gb = fit.gradient(w, b)
    # A toxic text without words costs the same whatever is learnt; what is left of the slope is small.
    assert fit.loss(w, b) < 0.5 * fit.loss(np.zeros(len(chosen)), T.BIAS) and max(abs(gw).max(), abs(gb)) < 2e-3


def test_recall_of_held_out_documents(spark):
    """sf0.1: of held-out toxic documents 9 in 10 are found, of clean ones 1 in 100 at most is rejected; by language for the record."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    found, by = [0, 0, 0, 0], {}
    for r in T.score(docs, labels).collect():
        if r["held_out"] and truth.get(r["doc_id"]) is not None:
            assert zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            k = (0 if r["predicted"] else 1) if truth[r["doc_id"]] else (2 if r["predicted"] else 3)
            found[k] += 1
            by.setdefault(lang[r["doc_id"]], [0, 0, 0, 0])[k] += 1
    assert found[0] / (found[0] + found[1]) >= 0.9 and found[2] / (found[2] + found[3]) <= 0.01
    assert all(b[0] / (b[0] + b[1]) >= 0.75 for b in by.values())


def test_cut_moves_the_score():
    m = T.Model({"bad": 7.0}, -8.0, cut=0.2)
    raw = T.Model({"bad": 7.0}, -8.0).score("a bad one")
    assert 0.2 < raw < 0.5 < m.score("a bad one") and m.score("fine") < 0.01
    assert T.calibrated(0.2, 0.2) == 0.5 and T.calibrated(0.0, 0.2) == 0.0 and T.calibrated(1.0, 0.2) == 1.0


def test_cut_needs_enough_documents():
    sample = T.Sample([("a b", 0), ("c d", 1)] * 6)
    assert T.cut_of(sample, *sample.held_by(T.FOLDS)) == 0.5


def test_keep_clean(spark, docs_of):
    rows, labels = corpus()
    labels = spark.createDataFrame(labels + [(99_999, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    r = random.Random(1)
    long = " ".join(r.choice(["word1", "word2", "word3"]) for _ in range(300_000))
    odd = [(None, None), (9000, ""), (7, rows[7][1]), (9001, long + ". You vilest scumlike idiotic one."), (9002, long)]
    d = docs_of(rows + odd).withColumn("score", F.lit(1)).withColumn("toxic", F.lit("x")).withColumn("own_id", F.lit(0)).withColumn("doc", F.struct("doc_id"))
    kept = T.keep_clean(d, labels)
    assert kept.columns == d.columns
    scores = {(x["doc_id"], x["text"]): x["score"] for x in T.scored(d.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.lit(1)), T.train(d, labels)).join(d.select("doc_id", "text"), "doc_id").collect()}
    got = kept.collect()
    assert {x["doc_id"] for x in got} >= {None, 9000, 9002} and 9001 not in {x["doc_id"] for x in got}
    assert all(scores[x["doc_id"], x["text"]] < 0.5 for x in got if x["doc_id"] is not None and (x["doc_id"], x["text"]) in scores)
    assert sum(x["doc_id"] == 7 for x in got) == 2
    assert T.keep_clean(docs_of([]), labels).count() == 0
    assert T.keep_clean(d, labels.where("false")).count() == d.count()
