"""Ranked search against scoring every document for every item."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, limit=20):
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for t, k in df.items()}
    out = []
    for item, text in items:
        asked, scores = Counter(terms(text)), []
        for d, c in held:
            m = 100 - 25 + 25 * sum(c.values()) * n // length
            score = sum(q * w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores)[:limit])]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def items_of(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


DOCS = [
    (1, "Ätna ätna Straße 12, a-b c_d"), (2, "ÄTNA straße"), (3, None), (4, ""), (5, "—"), (6, "!!! ,,, \x00"), (None, "ätna\u0085x ätna"), (None, "straße"), (7, "straße"), (7, "straße"), (8, "wort " * 30_000 + "ätna"),
    *[(k, "gleich und gleich") for k in range(100, 160)], *[(k, f"wort{k % 7} straße {'lang ' * (k % 13)}") for k in range(200, 320)],
]
ITEMS = [(1, "ätna STRASSE straße straße"), (2, "gleich"), (3, "nirgends"), (4, None), (5, ""), (6, "wort1 wort2 lang lang gleich"), (2, "gleich"), (None, "und straße"), (7, "wort ätna 12")]


def test_against_every_document(spark, docs_of):
    docs = docs_of(DOCS).repartition(5)
    expected = plain(DOCS, ITEMS)
    assert rows(ranked.ranked(docs, items_of(spark, ITEMS))) == expected
    assert len([r for r in expected if r[0] == 2]) == 40
    # Several blocks of items, and other limits.
    assert rows(ranked.ranked(docs, items_of(spark, ITEMS), most=2)) == expected
    assert rows(ranked.ranked(docs, items_of(spark, ITEMS), 3, most_bytes=10)) == plain(DOCS, ITEMS, 3)


def test_empty_tables_and_clashing_columns(spark, docs_of):
    items = items_of(spark, ITEMS)
    assert ranked.ranked(docs_of([]), items).count() == 0 == ranked.ranked(docs_of(DOCS), items_of(spark, [])).count()
    assert ranked.ranked(docs_of([(1, None)]), items).count() == 0
    names = ("item", "item_id", "rank", "score", "part", "ids", "n", "tfs", "number", "count")
    odd = docs_of(DOCS).select("*", *[F.lit("x").alias(c) for c in names])
    assert rows(ranked.ranked(odd, items.select("*", *[F.lit(0).alias(c) for c in names if c != "item_id"], F.lit(0).alias("doc_id")))) == plain(DOCS, ITEMS)


@pytest.mark.parametrize("seed", range(6))
def test_levels_stop_early_and_lose_nothing(seed):
    """Lists of many documents: what ``best`` gives holds every document at or above the limit-th score, though it leaves groups unread."""
    rng = np.random.default_rng(seed)
    docs, vocabulary, limit = 3000, 40, 5
    held = rng.random((docs, vocabulary)) < rng.choice([0.02, 0.4, 0.9], vocabulary)
    held[~held.any(axis=1), 0] = True
    impacts = rng.integers(0 if seed % 2 else 1, 10 ** (1 + seed), (docs, vocabulary))
    d, t = np.nonzero(held)
    shard = ranked.Shard(np.arange(docs), np.zeros(docs, dtype=bool), np.append(0, np.cumsum(held.sum(axis=1))), t, impacts[d, t], vocabulary)
    for least in (1, 10**seed):
        numbers = rng.choice(vocabulary, 6, replace=False)
        counts = rng.integers(1, 4, 6)
        scores = ((held * impacts)[:, numbers] * counts).sum(axis=1)
        found, got = shard.best(numbers, counts, limit, least)
        bound = max(np.sort(scores)[-limit], least)
        assert set(np.flatnonzero(scores >= bound)) <= set(found.tolist()) and (scores[found] == got).all()
        assert not shard.found.any() and not shard.weight.any()


def test_groups_are_taken_from_the_highest_impact_down():
    """One document stands out: its groups are read, those of the others are not."""
    ends, ids = np.arange(0, 2 * 1001, 2), np.tile([0, 1], 1000)
    impacts = np.full(2000, 3)
    impacts[500:502] = 1000
    shard = ranked.Shard(np.arange(1000), np.zeros(1000, dtype=bool), ends, ids, impacts, 2)
    seen = []
    shard.complete, whole = lambda docs, *a: (seen.append(len(docs)), whole(docs, *a))[1], shard.complete
    assert [x.tolist() for x in shard.best(np.array([0, 1]), np.array([1, 1]), 1, 1)] == [[250], [2000]] and seen == [1]


def test_a_hot_term_over_all_documents(spark, docs_of):
    docs = [(k, "the " * (1 + k % 3) + ("rare" if k % 400 == 0 else "other")) for k in range(4000)]
    items = [(1, "the rare"), (2, "the"), (3, "the the other")]
    assert rows(ranked.ranked(docs_of(docs).repartition(7), items_of(spark, items))) == plain(docs, items)
