"""SimHash, embedding near-dedup and components against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spindrift.llm import components, embedding_dedup, simhash, tiles


def union(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({k: " " for k in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = ["", "  \t\n", "A", "a B", "the cat sat on the mat", "The CAT sat\ton the mat", "ÄÖ ä\u00a0b c d e\u2003f", "x " * 70_000, "e\x1cf g h i"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_hash_is_sparks(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("ä b c"))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest("ä b c".encode(), 42)


def fps_with_chains(seed, n=600):
    rng = np.random.default_rng(seed)
    fp = rng.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False)
    for k in range(n // 2, n):  # near ones of those before, also chains
        at = int(rng.integers(0, k))
        fp[k] = fp[at] ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, int(rng.integers(0, 6)), replace=False).astype(np.uint64), initial=np.uint64(0))
    return np.unique(fp)


@pytest.mark.parametrize("limit", [4, 2048])
def test_links_are_all_links(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "TILE", limit)
    fp = fps_with_chains(1)
    near = np.argwhere(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3)
    want = union(len(fp), near)
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long"))
    at = {int(x): k for k, x in enumerate(fp.view(np.int64))}
    got = union(len(fp), [(at[r["a"]], at[r["b"]]) for r in edges.collect()])
    assert got == want
    assert len(set(want)) < len(fp)


def test_dense_group_is_not_quadratic(spark):
    base = np.uint64(0x0123456789ABCDEF)
    fp = np.unique([base ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a in range(64) for b in range(64)])
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long"))
    assert edges.count() < 12 * len(fp)
    assert components.connected_components(edges).select("component").distinct().count() == 1


def test_near_duplicates(spark, docs_of):
    rows = [(5, "same words here now"), (3, "Same words\there now"), (9, ""), (7, None), (8, " \n"), (None, "same words here now"), (None, "alone by itself today ok"), (4, "quite another text it is"), (4, "quite another text it is")]
    found = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs_of(rows)).collect()}
    hexed = lambda t: f"{plain_fingerprint(t or ''):016x}"
    want = {(5, 3), (3, 3), (9, 7), (7, 7), (8, 7), (None, 3), (None, None), (4, 4)}
    assert {(a, c) for a, _, c in found} == want and {f for _, f, _ in found} == {hexed(t) for _, t in rows}
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_keep_one(docs_of):
    rows = [(5, "same words here now"), (3, "Same words here now"), (9, ""), (7, None), (4, "quite another text it is"), (4, "quite another text it is"), (4, "and this one is different from all"), (None, "alone by itself today ok"), (None, "alone by itself today ok")]
    d = docs_of(rows).withColumn("row", F.lit(1)).withColumn("digest", F.lit("x")).withColumn("fp", F.lit(2)).withColumn("own_id", F.lit(3))
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(3, "Same words here now"), (7, None), (4, "quite another text it is"), (4, "and this one is different from all"), (None, "alone by itself today ok")], key=repr)
    assert simhash.keep_one(docs_of([])).count() == 0


def test_documents(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet").collect()
    fp = np.array([plain_fingerprint(r["text"]) for r in d], dtype=np.uint64)
    root = union(len(d), np.argwhere(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3))
    least = {}
    for k, r in enumerate(d):
        least[root[k]] = min(r["doc_id"], least.get(root[k], r["doc_id"]))
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    assert found == {r["doc_id"]: (f"{int(fp[k]):016x}", least[root[k]]) for k, r in enumerate(d)}


@pytest.mark.parametrize("small", [0, None])
def test_components(spark, small):
    rng = np.random.default_rng(5)
    n = 300
    pairs = [(k, k + 1) for k in range(0, 80)] + [(100, k) for k in range(101, 160)] + [tuple(map(int, rng.integers(160, n, 2))) for _ in range(60)]
    want = union(n, pairs)
    edges = spark.createDataFrame([(b, a) if a % 2 else (a, b) for a, b in pairs] + [(7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(edges, small=small).collect()}
    assert got == {k: want[k] for p in pairs for k in p if any(k in q and q[0] != q[1] for q in pairs)}
    assert components.connected_components(edges.where("false"), small=small).count() == 0


def test_every_pair_meets_once(spark):
    rows = spark.createDataFrame([(k % 3, k) for k in range(50)] + [(9, 999)], "g int, m long")
    dealt = tiles.dealt(rows, ["g"], "m", 4).collect()
    met = []
    by = {}
    for r in dealt:
        by.setdefault((r["g"], r["tile"]), []).append(r)
    for (_, tile), rs in by.items():
        cross = tile >> 31 != tile & (1 << 31) - 1
        met += [tuple(sorted((a["m"], b["m"]))) for k, a in enumerate(rs) for b in rs[k + 1 :] if not cross or a["side"] != b["side"]]
    assert sorted(met) == sorted((a, b) for a in range(50) for b in range(a + 1, 50) if a % 3 == b % 3)


# ---- embeddings


def vectors(seed=2, n=400, dims=24):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    for k in range(n // 3, n):
        x[k] = x[int(rng.integers(0, k))] * rng.uniform(0.1, 50) + rng.normal(size=dims) * rng.uniform(0, 0.12) * 10
    x[1] = x[0]
    return x, rng.integers(0, 3, n)


def brute_vectors(rows, least):
    sound = [k for k, (_, e, lab) in enumerate(rows) if lab is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    links = []
    for p, a in enumerate(sound):
        for b in sound[p + 1 :]:
            if rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links.append((a, b))
    root, degree = union(len(rows), links), np.bincount(np.array(links, dtype=int).ravel(), minlength=len(rows))
    least_id = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least_id[root[k]] = min(r[0], least_id.get(root[k], r[0]))
    return sorted(((r[0], int(degree[k]), least_id.get(root[k]), r[0] == least_id.get(root[k])) for k, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("limit", [16, None])
def test_embeddings(spark, monkeypatch, limit):
    monkeypatch.setattr(embedding_dedup, "TILE", limit)
    x, labels = vectors()
    rows = [(k, x[k].tolist(), int(labels[k])) for k in range(len(x))]
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 24, 1), (503, [None] + [1.0] * 23, 1), (504, [float("nan")] * 24, 1), (505, [float("inf")] * 24, 1), (506, x[0].tolist(), None)]
    rows += [(507, [1.0, 0.0], 1), (508, [2.0, 0.01], 1), (509, x[0].tolist(), int(labels[0])), (509, x[0].tolist(), int(labels[0])), (None, x[0].tolist(), int(labels[0]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("gid", F.lit(1)).withColumn("n", F.lit("x"))
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()), key=repr)
    want = brute_vectors(rows, 0.93)
    assert got == want and sum(w[1] for w in want) > 50


def test_bounds_hold():
    x, _ = vectors(9, 200)
    u, q, s, e = embedding_dedup.quantised(x)
    approx = (q.astype(float) @ q.astype(float).T) * s[:, None] * s[None, :]
    assert (np.abs(u @ u.T - approx) <= e[:, None] + e[None, :] * (1 + e[:, None])).all()


def test_no_vectors(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_clashing_columns_of_simhash(docs_of):
    """Columns named as the operator names its own change nothing."""
    docs = docs_of([(k, f"eins zwei drei vier {k % 4}") for k in range(12)] + [(None, None), (20, "")])
    odd = docs.withColumns({c: F.lit("x") for c in ("fp", "key", "tile", "side", "digest", "component", "component_id", "least_id", "_fp", "node", "fingerprint")})
    rows = [sorted((tuple(r) for r in simhash.near_duplicates(d).collect()), key=repr) for d in (docs, odd)]
    assert rows[0] == rows[1] and len(rows[0]) == 14
