import hashlib

import pytest
from pyspark.sql import functions as F

from spindrift.llm import line_dedup as D


def plain_chunks(lines):
    """(first, one past the last) of each chunk, by a scan from line to line."""
    n, h = len(lines), [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % D.MODULUS for x in lines]
    r = [((h[k - 1] if k else 0) * D.BASE + h[k]) % D.MODULUS for k in range(n)]
    out, first, run = [], 0, 0
    for k in range(n):
        run = run + 1 if k and lines[k] == lines[k - 1] else 0
        if k == n - 1:
            ends = True
        elif k < 1 or k > n - 3:
            ends = False
        else:
            ends = run % 2 == 1 if lines[k] == lines[k + 1] else r[k] < min(r[k - 1], r[k + 1])
        if ends:
            out.append((first, k + 1))
            first = k + 1
    return out


def brute(rows, long_words=50):
    """Rows to their texts; of repeated chunks, and of long lines, the first by (id, md5, place) stays."""
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    distinct = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, md5(r[1])))
    seen, texts = set(), {}
    for i, t in distinct:
        lines, gone = t.split("\n"), set()
        units = [(a, z) for a, z in plain_chunks(lines) if z - a > 1]
        units += [(k, k + 1) for k, x in enumerate(lines) if long_words is not None and x.count(" ") >= long_words]
        for a, z in units:
            c = "\n".join(lines[a:z])
            if c in seen:
                gone |= set(range(a, z))
            seen.add(c)
        texts[i, t] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return sorted(((i, None if t is None else texts[i, t]) for i, t in rows), key=repr)


def passage(k, n=8):
    return "\n".join(f"passage {k} line {j} with words" for j in range(n))


def case():
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(k, f"own {k}\nfirst {k}\n" + passage(k % 3, 20) + f"\nend {k}\nlast {k}") for k in range(12)]
    rows += [(100, long), (101, f"before\n{long}\nafter"), (102, f"x\ny\n{long}"), (103, passage(7) + "\n" + passage(7)), (104, ""), (105, None), (106, "\n\n\n\n"), (None, passage(0, 20)), (None, None)]
    return rows + [(3, rows[3][1]), (3, "same id, other text\n" + passage(1, 20))]


@pytest.mark.parametrize("long_words", [50, None])
def test_dedup(docs_of, long_words):
    rows = case()
    d = docs_of(rows).withColumn("row", F.lit(1)).withColumn("gone", F.lit("x")).withColumn("rest", F.lit(2)).withColumn("digest", F.lit(3))
    out = D.dedup(d, long_words=long_words)
    assert [c for c in out.columns if c != "cut_"] == d.columns
    got = out.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == brute(rows, long_words)
    assert sum(r["cut_"] for r in got) > 100
    by = {r["doc_id"]: r["text"] for r in got if r["doc_id"] in (100, 101, 102)}
    assert by[100].startswith("w0 ") and (by[101] == "before\nafter", by[102] == "x\ny") == (long_words is not None,) * 2


def test_clean_documents_stay(docs_of):
    rows = [(k, "\n".join(f"{k} {j} unlike any" for j in range(40))) for k in range(20)]
    assert sorted((r["doc_id"], r["text"]) for r in D.dedup(docs_of(rows)).collect()) == rows


def test_boundaries_come_back():
    lines = [f"line {k}" for k in range(200)]
    a = {tuple(lines[x:y]) for x, y in plain_chunks(lines)}
    moved = ["new"] * 3 + lines[:100] + ["inserted"] + lines[100:]
    b = {tuple(moved[x:y]) for x, y in plain_chunks(moved)}
    assert len(a & b) > 0.85 * len(a)


def test_empty(docs_of):
    assert D.dedup(docs_of([])).count() == 0


def test_chunks_have_two_lines(spark):
    texts = [[f"line {k * k % 17}" for k in range(n)] for n in range(1, 40)] + [["same"] * n for n in range(1, 12)] + [["a", "b", *["same"] * 7, "c", "same", "same", "d"]]
    got = [[tuple(c) for c in r[0]] for r in spark.createDataFrame([(t,) for t in texts], "t array<string>").select(D.chunks(F.col("t"))).collect()]
    assert got == [[(a, z - a) for a, z in plain_chunks(t)] for t in texts]
    assert all(n > 1 for t, cs in zip(texts, got, strict=True) for _, n in cs if len(t) > 1)


def test_later_copies_go_whole(docs_of):
    texts = [passage(k, 4 + k) for k in range(9)]
    got = D.dedup(docs_of([(k, t) for k, t in enumerate(texts * 3)])).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {k: t if k < 9 else "" for k, t in enumerate(texts * 3)}


def test_few_repeated_windows_stay(spark):
    """sf0.1: of four lines in a row that occur again, under 5 % stay; later exact copies of four lines or more go whole."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    before, after = ({r["doc_id"]: (r["text"] or "").split("\n") for r in d.collect()} for d in (docs, D.dedup(docs)))

    def repeats(texts):
        windows = [tuple(t[k : k + 4]) for t in texts.values() for k in range(len(t) - 3)]
        return len(windows) - len(set(windows))

    assert repeats(after) < 0.05 * repeats(before)
    seen = set()
    for i in sorted(before):
        t = "\n".join(before[i])
        assert len(before[i]) < 4 or t not in seen or after[i] == [""]
        seen.add(t)


def test_long_texts(docs_of):
    many = "\n".join(f"line {k}" for k in range(60_000))
    rows = [(1, many), (2, many + "\nend"), (3, "\n" * 60_000), (4, "w " * 200_000), (5, "x\n" + "w " * 200_000)]
    got = sorted((r["doc_id"], r["text"]) for r in D.dedup(docs_of(rows)).collect())
    assert got == brute(rows) and len(got[1][1]) < 100
