import bisect
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spindrift.llm import fingerprint as P

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain_runs(line):
    """Runs of a line, character by character: they end after a word that ends so, the eighth word or 32 characters of a word."""
    out, at = [], 0
    while at < len(line):
        start = at
        while at < len(line) and line[at] == " ":
            at += 1
        if at > start:
            out.append(line[start:at])
            continue
        for k in range(8):
            end = at
            while end < len(line) and line[end] != " " and end <= at + 32:
                end += 1
            to = end
            while to < len(line) and line[to] == " ":
                to += 1
            if k < 7 and end - at <= 32 and to > end and line[end - 1] not in "aehnst.,;:!?|" and to < len(line):
                at = to
                continue
            at = to if end - at <= 32 else at + 32
            break
        out.append(line[start:at])
    return out


def plain_tree(text):
    leaves = [[sha("l" + r) for r in plain_runs(x)] for x in text.split("\n")]
    p = [sha("p" + "".join(x)) for x in leaves]
    sections, held = [], ""
    for k, (h, x) in enumerate(zip(p, text.split("\n"), strict=True)):
        held += h
        if h[0] in "01" or not x or k == len(p) - 1:
            sections.append(sha("s" + held))
            held = ""
    return sha("r" + "".join(sections)), sections, p, leaves


def plain_likeness(a, b):
    if a == b:
        return 1.0
    levels = [(set(x[1]), set(x[2]), {h for p in x[3] for h in p}) for x in (plain_tree(a), plain_tree(b))]
    return round(2 * sum(len(x & y) for x, y in zip(*levels, strict=True)) / (2 + sum(len(x) for t in levels for x in t)), 6)


def plain_edit(a, b):
    """By the lines themselves: (first, lines of the first text)."""
    if a == b:
        return None, None
    a, b = a.split("\n"), b.split("\n")
    head = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return head, len(a) - head - tail


PAIRS = [
    ("a\nb", "b\na"), ("a\na\nb", "a\nb"), ("a\nb", "a\nb\nc"), ("", "x"), ("x", ""), ("a\n\nb\n\nc", "a\n\nc"), ("same", "same"), ("u\nu\nv", "u\nv"), ("v\nu", "v\nu\nu\nu"),
    ("one two three four five six seven eight nine ten", "one two three four five six seven eight nine"),
]


def test_tree_and_edits(spark):
    texts = ["", "a", "a\nb", "a\n\nb\n", "\n".join(f"line {k}" for k in range(200)), "ü🙂\nß", "  lead  and   more ", "x" * 100 + " y", "go up by my own law of log and cup then  end.", " "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(P.tree(F.col("t")).alias("x")).collect()
    for t, r in zip(texts, rows, strict=True):
        assert (r["x"]["root"], r["x"]["sections"], r["x"]["paragraphs"], r["x"]["leaves"]) == plain_tree(t)
        assert "\n".join("".join(plain_runs(x)) for x in t.split("\n")) == t
    r = random.Random(3)
    pairs = list(PAIRS)
    for _ in range(150):
        a = [f"line {r.randrange(30)}" if r.random() < 0.9 else "" for _ in range(r.randrange(0, 60))]
        b = list(a)
        for _ in range(r.randrange(0, 4)):
            at, kind = r.randrange(len(b) + 1), r.randrange(4)
            if kind == 0:
                b.insert(at, f"new {r.randrange(5)}")
            elif kind == 1 and b:
                del b[min(at, len(b) - 1)]
            elif kind == 2 and b:
                b[min(at, len(b) - 1)] += " edit"
            elif b:
                b.insert(at, b.pop(r.randrange(len(b))))
        pairs.append(("\n".join(a), "\n".join(b)))
    a, b = P.tree(F.col("a")), P.tree(F.col("b"))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", P.edit(a, b).alias("e"), P.likeness(a, b).alias("n")).collect()
    for x in got:
        assert (tuple(x["e"]) if x["e"] else (None, None)) == plain_edit(x["a"], x["b"])
        assert x["n"] == plain_likeness(x["a"], x["b"]) and (x["e"] is None) == (x["a"] == x["b"])


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, sha(r[1])), reverse=True)
    out = []
    for k, (i, t) in enumerate(rows):
        following, n = rows[(k + 1) % len(rows)][1], len(t)
        edited = t[: n - n // 3] + following[: n // 3]
        out.append((i, n, sha(edited), plain_tree(t)[0], plain_tree(edited)[0], plain_likeness(t, edited), plain_likeness(t, following), *plain_edit(t, edited)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("buckets", "equal"), [(None, 1000), (7, 3), (40, 5)])
def test_next_over_many_ranges(spark, docs_of, buckets, equal):
    rows = [(3 * k * k, f"text {k}\n" * (k % 9) + "ü" * (k % 4)) for k in range(97)]
    rows += [(12, "twice"), (12, "twice"), (12, "other"), (None, "no id"), (None, None), (-5, ""), (1 << 62, "x" * 5000)]
    # An id and no id with very many rows, of one text and of many.
    hot = [(300, "hot")] * 60 + [(300, f"of one id {k}") for k in range(60)] + [(None, f"of no id {k}") for k in range(50)] + [(None, "")] * 30
    for part in (rows + hot, rows[:1], rows[:2], [(None, None)], [(4, "a")] * 20, []):
        found = P.edited_fingerprints(docs_of(part), buckets, equal).collect()
        assert sorted((tuple(r) for r in found), key=repr) == brute(part)
        assert all((r["near_edited"] == 1) == (r["fingerprint"] == r["edited_fingerprint"]) for r in found)


def test_bounds(spark):
    r = random.Random(8)
    spread = [r.randrange(-(1 << 63), 1 << 63) for _ in range(3000)]
    close = [10**15 + k for k in range(3000)]
    for ids in (spread, close, spread + close, [5] * 2000 + close, [7], [-1, 1 << 62], [None] * 500 + [3] * 500):
        keys = spark.createDataFrame([(i,) for i in ids], "doc_id long")
        times, unnamed = P.bounds_of(keys, 20)
        most, bounds = max(1, len(ids) // 20), sorted(times)
        held, inner = Counter(), Counter(i for i in ids if i is not None)
        for i, c in inner.items():
            at = bisect.bisect_right(bounds, i)
            if at and bounds[at - 1] == i and times[i] > 1:
                assert c <= most * times[i]
            else:
                held[at] += c
        assert all(c <= most for c in held.values()) or len(ids) < 20
        assert len(bounds) <= 2 * 20 + 2 and (ids.count(None) // most) + 1 == unnamed
    assert P.bounds_of(spark.createDataFrame([(None,)], "doc_id long"), 4) == ({}, 2)


def test_hot_ids_fill_several_parts(spark, docs_of):
    """No window holds the rows of an id, or of none, that are a large share of the table."""
    rows = [(k, f"t{k}") for k in range(200)] + [(50, f"hot {k}") for k in range(200)] + [(None, f"none {k}") for k in range(200)] + [(60, "equal")] * 200
    plan = P.with_next(docs_of(rows), 30, 20)
    windows = Counter()
    for r in plan.select("doc_id", F.spark_partition_id().alias("p")).collect():
        windows[r["doc_id"]] += 1
    assert windows[50] == 201 and windows[None] == 200 and windows[60] == 2
    seen = P.with_next(docs_of(rows), 30, 20)._jdf.queryExecution().toString()
    assert "Window" in seen
    keys = docs_of(rows).select("doc_id", F.sha2("text", 256).alias("digest"))
    assert keys.count() == 800


def test_extra_columns(docs_of):
    d = docs_of([(1, "a"), (2, "b")]).withColumn("bucket", F.lit(1)).withColumn("digest", F.lit("x")).withColumn("at", F.lit(0)).withColumn("guest", F.lit(None))
    assert P.edited_fingerprints(d).count() == 2


def test_many_paragraphs(docs_of):
    """Texts of very many paragraphs and sections take time in proportion."""
    rows = [(1, "\n" * 40_000), (2, "line one\n" * 40_000), (3, "x" * 1_000_000)]
    found = P.edited_fingerprints(docs_of(rows)).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in found} == {i: plain_tree(t)[0] for i, t in rows}
