"""The line model against enumeration and finite differences, odd texts, and held-out accuracy."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from spindrift.llm import quality
from spindrift.llm.quality import Chains, Model, _marginals, binned, fit, measures

GOOD = "Der Bericht nennt die Zahlen des Jahres. Er folgt dem Plan, den alle kennen."
BAD = "KAUFEN!! JETZT!! ### BILLIG!! $$$ %%% *** KLICK!!"


def random_chains(rng, counts):
    bins = rng.integers(0, 8, (sum(counts), len(quality.FEATURES))).astype(np.uint8)
    return Chains(bins, np.array(counts)), rng.normal(0, 0.3, quality.SIZE), rng.normal(0, 0.5, (2, 2))


def test_marginals_and_partition_by_enumeration(monkeypatch):
    counts, rng = [1, 4, 6, 2], np.random.default_rng(0)
    chains, w, a = random_chains(rng, counts)
    bad, _, total = chains.passes(w, a)
    z, at, log = w[chains.features].sum(axis=1), 0, 0.0
    for n in counts:
        own = z[at : at + n]
        weights = {y: np.exp(sum(y[k] * own[k] for k in range(n)) + sum(a[y[k - 1], y[k]] for k in range(1, n))) / 2 for y in itertools.product((0, 1), repeat=n)}
        whole = sum(weights.values())
        expected = [sum(v for y, v in weights.items() if y[k]) / whole for k in range(n)]
        np.testing.assert_allclose(bad[at : at + n], expected)
        np.testing.assert_allclose(_marginals(np.exp(own).tolist(), a), expected)
        log, at = log + np.log(whole), at + n
    np.testing.assert_allclose(total, log)


def test_gradient(monkeypatch):
    monkeypatch.setattr(quality, "CHAIN", 5)
    rng = np.random.default_rng(1)
    chains, w, a = random_chains(rng, [3, 12, 1, 7])
    y = rng.integers(0, 2, 23)
    _, gw, ga = chains.gradient(w, a, y)
    for k in np.flatnonzero(np.abs(gw) > 1e-4)[:12]:
        step = np.zeros_like(w)
        step[k] = 1e-5
        assert abs((chains.gradient(w + step, a, y)[0] - chains.gradient(w - step, a, y)[0]) / 2e-5 - gw[k]) < 1e-6
    for k in range(4):
        step = np.eye(4)[k].reshape(2, 2) * 1e-5
        assert abs((chains.gradient(w, a + step, y)[0] - chains.gradient(w, a - step, y)[0]) / 2e-5 - ga.ravel()[k]) < 1e-6


def test_long_chains_stay_finite():
    p = _marginals([1e6, 1e-6] * 20_000, np.array([[2.0, -2.0], [-2.0, 2.0]]))
    assert np.isfinite(p).all() and (p >= 0).all() and (p <= 1).all()


def sample(texts):
    return [(label, binned(measures(t)[0]), np.array(measures(t)[1])) for label, t in texts]


def test_lines_are_told_apart_within_a_bad_document():
    texts = [(1, "\n".join([GOOD] * (1 + k % 5))) for k in range(60)] + [(0, "\n".join([GOOD] * 2 + [BAD] * (8 + k % 3) + [GOOD])) for k in range(40)]
    model = fit(sample(texts))
    (p, sizes), (q, _) = model.lines(["\n".join([GOOD, GOOD, BAD, BAD, BAD, GOOD]), GOOD])
    assert (p[2:5] > 0.5).all() and (p[[0, 5]] < 0.5).all() and (q < 0.5).all() and sizes[0] == len(GOOD.encode()) + 1
    scores = model.scores(["\n".join([BAD] * 5), GOOD, "\n".join([GOOD] * 2 + [BAD] * 9)])
    assert scores[0] < 0.5 < scores[1] and scores[2] < 0.5


def test_one_class_or_none():
    assert fit([]).scores(["x"]) == [0.5]
    assert fit(sample([(1, GOOD)] * 9)).scores(["", GOOD])[0] > 0.9
    assert fit(sample([(0, GOOD)] * 9)).scores([BAD])[0] < 0.1


def test_odd_texts(spark, docs_of):
    texts = [None, "", "\n", "\n\n\n", " ", "\x00", "é" * 10, BAD, GOOD, "a\n" * 50_000, "wort " * 200_000, "\U0001f600\n" * 3]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, GOOD), (7, BAD), (7, BAD)] + [(100 + k, GOOD if k % 2 else BAD) for k in range(120)]
    labels = spark.createDataFrame([(100 + k, k % 2, 0) for k in range(120)] + [(100, 1, 1), (None, 1, 0), (999, 0, 0), (5, None, 0), (6, 7, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of(rows).withColumns({c: F.lit("x") for c in ("score", "predicted", "held_out", "quality", "lid", "bins")})
    out = quality.score(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    by = {r["doc_id"]: r["score"] for r in out}
    assert by[7] < 0.5 < by[8] and by[0] == by[1] and [r["score"] for r in out if r["doc_id"] is None] == [by[8]]
    assert quality.score(docs_of([]), labels).count() == 0
    assert {r["score"] for r in quality.score(docs_of(rows[:3]), labels.limit(0)).collect()} == {0.5}
    lines = quality.labelled_lines(docs_of([(1, f"{GOOD}\n{BAD}"), (2, None)]), Model(np.zeros(quality.SIZE), np.zeros((2, 2)))).collect()
    assert [(r["doc_id"], r["line_no"], r["probability"]) for r in lines] == [(1, 0, 0.5), (1, 1, 0.5), (2, 0, 0.5)]


def test_labels_of_held_out_rows_are_not_used(spark, docs_of):
    docs = docs_of([(k, GOOD if k % 2 else BAD) for k in range(150)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(150)], "doc_id long, quality int, toxic int")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    own, other = ({r["doc_id"]: r["score"] for r in quality.score(docs, x).collect()} for x in (labels, turned))
    assert own == other


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = quality.query(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").groupBy("quality", "predicted").count().collect()
    n = {(r["quality"], r["predicted"]): r["count"] for r in rows}
    assert n.get((0, 0), 0) / (n.get((0, 0), 0) + n.get((0, 1), 0)) >= 0.95
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) >= 0.99
