"""Mixing, sharding, SentencePiece, URL filters, toxicity and packing against plain Python."""

import bisect
import hashlib
import math
import random
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import mixing, packing, pieces, sharding, toxicity, urls


def md5_uniform(key):
    return (int(hashlib.md5(key.encode()).hexdigest()[:13], 16) + 0.5) / 2**52


# ---- mixing


def plain_copies(rows, weights, total, seed=17):
    """``rows`` are dictionaries with a source."""
    digest = lambda r, names: hashlib.sha256("".join(part(c, r[c]) for c in sorted(names)).encode()).hexdigest()
    n = Counter(r["source"] for r in rows)
    w = {s: (n[s] ** 0.5 if weights is None else weights.get(s, 0.0)) for s in n}
    out, numbers = [], Counter()

    def part(name, v):
        if v is None:
            return "-"
        v = hashlib.sha256(v.encode()).hexdigest() if name == "text" else str(v)
        return f"+{len(v)}:{v}"

    kinds = {}
    for r in rows:
        kinds.setdefault(digest(r, ("doc_id", "text", "source")), set()).add(digest(r, r))
    for r in rows:
        mean = total * w[r["source"]] / sum(w.values()) / n[r["source"]]
        parts = max(1, math.ceil(mean / 16))
        cdf, p = [], math.exp(-mean / parts)
        for k in range(97):
            cdf.append((cdf[-1] if cdf else 0) + p)
            p *= mean / parts / (k + 1)
        own, whole = digest(r, ("doc_id", "text", "source")), digest(r, r)
        key = f"{seed}/{own}/{whole + '/' if len(kinds[own]) > 1 else ''}{numbers[own, whole]}/"
        numbers[own, whole] += 1
        count = sum(bisect.bisect_left(cdf, md5_uniform(f"{key}{j}")) for j in range(1, parts + 1))
        out += [(r["doc_id"], r["text"], r["source"], c) for c in range(1, count + 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [2, 4096])
@pytest.mark.parametrize(("weights", "total"), [(None, None), ({"a": 3.0, None: 1.0}, 900), ({"c": 1.0}, 400)])
def test_mixing(docs_of, weights, total, block, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rows = [(k, "t", "a" if k % 3 else "b") for k in range(120)] + [(500 + k, "t", "c") for k in range(4)] + [(700 + k, None, None) for k in range(10)] + [(5, "t", "b"), (5, "t", "b"), (5, "u", "b")]
    rows += [(None, f"text {k % 11}", "a" if k % 2 else "b") for k in range(90)] + [(None, None, "a"), (None, "", "a"), (None, None, "a")]
    d = docs_of(rows).withColumn("row", F.lit(1)).withColumn("_n", F.lit(2)).withColumn("copy_", F.lit(3)).withColumn("own_key", F.lit("x")).withColumn("number", F.when(F.col("doc_id").isNull(), F.col("text").isNull().cast("int")))
    d = d.unionByName(d.where("doc_id < 3 or text = 'text 4'").withColumn("_n", F.lit(7)))
    whole = [{k: v for k, v in r.asDict().items() if k != "copy_"} for r in d.collect()]
    got = mixing.mixed(d, weights, total=total).collect()
    assert sorted(((r["doc_id"], r["text"], r["source"], r["copy_"]) for r in got), key=repr) == plain_copies(whole, weights, total or len(whole))
    assert [r["place_"] for r in got] == sorted(r["place_"] for r in got)
    assert mixing.mixed(docs_of([]), weights).count() == 0


def test_mixing_carries_texts(docs_of):
    rows = [(None, None)] * 40 + [(None, "")] * 40 + [(k, f"{k} " * 50_000) for k in range(9)]
    texts = dict(rows[80:])
    got = mixing.replicated(docs_of(rows), {"s": 1.0}).collect()
    assert all(r["text"] == texts[r["doc_id"]] if r["doc_id"] is not None else not r["text"] for r in got)
    # Equal rows draw apart: some of the forty stay, some go, none takes all with it.
    copies = Counter(r["text"] for r in got if r["doc_id"] is None)
    assert 20 < copies[None] < 65 and 20 < copies[""] < 65


def test_mixing_meets_the_target(docs_of):
    rows = [(k, "t", "big" if k % 10 else "small") for k in range(5000)]
    got = Counter(r["source"] for r in mixing.mixed(docs_of(rows), {"big": 1.0, "small": 1.0}).collect())
    assert abs(got["big"] - 2500) < 200 and abs(got["small"] - 2500) < 200


def test_mixing_of_rows_without_ids(spark, docs_of):
    """Half of the rows have no id, a third is one row over and over: both sources meet their targets, and the order has no hot range."""
    rows = [(None if k % 2 else k, "one and the same" if k % 3 == 0 else f"text {k}", "big" if k % 5 else "small") for k in range(20_000)]
    out = mixing.mixed(docs_of(rows), {"big": 2.0, "small": 1.0})
    got = Counter(r["source"] for r in out.select("source").collect())
    assert abs(got["big"] / 13_333 - 1) < 0.05 and abs(got["small"] / 6_667 - 1) < 0.05
    places = np.array([r["place_"] for r in out.select("place_").collect()], dtype=float)
    assert np.histogram(places, 40)[0].max() < 2 * len(places) / 40
    none = Counter(r["source"] for r in out.where("doc_id is null").select("source").collect())
    assert abs(none["big"] / 6_667 - 1) < 0.1 and abs(none["small"] / 3_333 - 1) < 0.1


# ---- sharding


def plain_shard(key, weights):
    return min((-math.log(md5_uniform(f"{key}/{k}")) / w, k) for k, w in enumerate(weights) if w > 0)[1]


@pytest.mark.parametrize("equal", [7, 100_000])
def test_sharding(docs_of, equal):
    rows = [(k, "ü" * (k % 7)) for k in range(400)] + [(3, "üüü"), (3, "üüü"), (None, None), (9, None)]
    rows += [(12, "a hot row")] * 150 + [(None, f"of no id {k}") for k in range(60)] + [(7, "long " * 200_000)]
    got = sharding.placed(docs_of(rows).withColumn("shard", F.lit(1)).withColumn("best", F.lit(2)).withColumn("rows", F.lit(3)), equal=equal).collect()
    key = lambda i: "null" if i is None else str(i)
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", plain_shard(key(i), [1] * 16), plain_shard(key(i), [1] * 17)) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got), key=repr) == want
    for s in range(16):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in got)
    assert sharding.placed(docs_of([])).count() == 0


def test_weighted_shards(spark):
    w = [1.0, 3.0, 0.0, 2.0]
    d = spark.range(6000).select(F.col("id").cast("string").alias("k"))
    got = Counter(r[0] for r in d.select(sharding.shard(F.col("k"), w)).collect())
    assert 2 not in got and all(abs(got[k] - 1000 * w[k]) < 150 for k in (0, 1, 3))
    assert [plain_shard(str(k), w) for k in range(50)] == [r[0] for r in d.where("int(k) < 50").select(sharding.shard(F.col("k"), w)).collect()]


# ---- pieces

TEXTS = ["", " ", "a", "Hello  world \n\t x", "ünïcödé ▁ sign", "🙂 emoji\u200d👩‍👩‍👧", "tail  ", "\x00nul", "<s>not</s> <unk> <0x41>", "日本語のテキスト", "a" * 3000, "é" * 50, "\u2028\ufeff\u00a0x"]


def test_pieces(docs_of):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rows = list(enumerate(TEXTS)) + [(99, None), (0, ""), (None, "x y")]
    got = pieces.encoded(docs_of(rows).withColumn("ids", F.lit(1))).collect()
    assert len(got) == len(rows)
    for (i, t), r in zip(sorted(rows, key=repr), sorted(got, key=lambda r: repr((r["doc_id"], None if r["doc_id"] == 99 else dict(rows).get(r["doc_id"])))), strict=True):
        t = t or ""
        ids = library.encode(t, add_eos=True)
        assert r["ids"] == ids and r["decoded"] == library.decode(ids)
        data = t.encode()
        assert r["ends"][-1] == len(data) and r["begins"][0] == 0
        assert all(b == e for b, e in zip(r["begins"][1:], r["ends"], strict=False))
    digest = {r["doc_id"]: r for r in pieces.digests(docs_of([(1, "Hello world"), (2, None)])).collect()}
    ids = library.encode("Hello world", add_eos=True)
    assert digest[1]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and digest[2]["n_tokens"] == 1
    assert digest[1]["decoded_sha256"] == hashlib.sha256(b"Hello world").hexdigest()


def test_spans_are_those_of_the_library():
    import sentencepiece

    own, library = pieces.encoder(pieces.model_path()), sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    for t in ["Hello  world", "héllo wörld", "日本 x"]:
        ids = own.encode([t])[0]
        spans = own.spans(t, ids)
        known = library.encode(t, return_type="proto").pieces
        for p, span in zip(known, spans.tolist(), strict=False):
            assert p.piece.startswith("<0x") or [p.begin, p.end] == span


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity", "nmt_nfkc_cf"])
def test_character_map(rule):
    """The compiled maps that the library holds, by its own normaliser."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    try:
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    except Exception as e:  # an older library has no normaliser of its own
        pytest.skip(str(e))
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    own = pieces.Normaliser(proto.normalizer_spec)
    alphabet = list("aB ﬁ①ｶﾞÅ\u0301ÄßĲ\u3000  \t\n½Ⅷ²™…") + ["日", "🙂", "\u00ad", "e\u0301"]
    r = random.Random(4)
    for _ in range(300):
        t = "".join(r.choice(alphabet) for _ in range(r.randrange(0, 25)))
        normal, source = own(t)
        assert normal.decode() == library.normalize(t)
        assert len(source) == len(normal) + 1 and (np.diff(source) >= 0).all() and source[-1] <= len(t.encode())


# ---- urls


def plain_verdict(host, path, rules):
    fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: (len(f[0].encode()), f[0].find("/")), default=(None, "allow"))


def test_urls(spark):
    cases = ["http://A.com", "https://example.com/en/1", "https://www.Example.com/en/x?y", "http://b.net/es/", "http://net/fr/a#b", "x.com/en/", None, "", "ftp://EXAMPLE.com/de/", "http://badexample.com/en/", "http://a.b.example.com/en/", "//x", "http:///en/", "http://x.net?/fr/", "http://ü.net/fr/é", "a://b://c.com/x", "http://x.com/line\nfeed?q"]
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").withColumn("host", F.lit("x"))
    got = {r["page_id"]: r for r in urls.judged(df).collect()}
    for k, u in enumerate(cases):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        assert (got[k]["host"], got[k]["path"]) == (host, path)
        assert (got[k]["rule"], got[k]["verdict"]) == plain_verdict(host, path, urls.RULES)
    assert urls.judged(df.where("false")).count() == 0


@pytest.mark.parametrize("max_bytes", [60, 1 << 20])
def test_rules_in_parts(spark, max_bytes):
    """Lists that one file cannot hold, a frame of rules, repeated rows and a very long url."""
    r = random.Random(5)
    rules = [(r.choice(["allow", "block"]), f"{'a.' * (k % 3)}h{k % 11}.org", "/" + "x/" * (k % 5)) for k in range(60)]
    rows = [(k, f"http://www.a.a.h{k % 14}.org/" + "x/" * (k % 7)) for k in range(80)] + [(5, "http://h5.org/x/")] * 3 + [(900, "http://h1.org/x/" + "y" * 300_000), (901, "http://" + "z." * 2000 + "h1.org/x/x/")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit(0))
    got = urls.judged(df, rules, max_bytes=max_bytes).collect()
    assert len(got) == len(rows)
    for x in got:
        assert (x["rule"], x["verdict"]) == plain_verdict(x["host"], x["path"], list({(h, p): (v, h, p) for v, h, p in rules}.values()))
    frame = spark.createDataFrame(rules + rules[:9] + [("block", None, "/")], "verdict string, host string, path string")
    block = {}
    for v, h, p in rules:
        block[h, p] = (max(v, block.get((h, p), (v,))[0]), h, p)
    got = urls.judged(df, frame, max_bytes=max_bytes).collect()
    assert len(got) == len(rows) and all((x["rule"], x["verdict"]) == plain_verdict(x["host"], x["path"], list(block.values())) for x in got)
    assert {x["verdict"] for x in urls.judged(df, frame.where("false")).collect()} == {"allow"}


def test_many_rules_and_collisions(tmp_path, monkeypatch):
    r = random.Random(1)
    rules = [(r.choice(["allow", "block"]), f"h{k}.x{k % 7}.org", f"/{k % 13}/") for k in range(3000)]
    # A digest of few values makes most probes collide: stored strings decide.
    real = urls.xxhash.xxh64_intdigest
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda b: real(b) % 50)
    path = tmp_path / "i"
    path.write_bytes(urls.build(rules))
    index = urls.Index(str(path))
    hosts, paths = [f"a.h{k}.x{k % 7}.org" for k in range(0, 4000, 9)], [f"/{k % 13}/y" for k in range(0, 4000, 9)]
    rule, verdict = index.judge(hosts, paths)
    for h, p, a, b in zip(hosts, paths, rule, verdict, strict=True):
        want = plain_verdict(h, p, rules)
        assert a == want[0] and (b or "allow") == want[1]
    path.write_bytes(urls.build([]))
    assert urls.Index(str(path)).judge(["a.com"], ["/"]) == ([None], [None])


def test_a_host_of_very_many_dots(tmp_path):
    path = tmp_path / "i"
    path.write_bytes(urls.build([("block", f"h{k}.org", "/") for k in range(500)] + [("allow", "x.h7.org", "/a/b/")]))
    index, host = urls.Index(str(path)), "a." * 200_000 + "x.h7.org"
    tracemalloc.start()
    began = time.perf_counter()
    assert index.judge([host, "." * 200_000, "h7.org", "xh7.org"], ["/a/b/c", "/", "/" * 100_000, "/"]) == (["x.h7.org/a/b/", None, "h7.org/", None], ["allow", None, "block", None])
    assert time.perf_counter() - began < 1 and tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()


def test_many_rules_are_indexed_in_tasks(spark):
    rules = spark.range(300_000).select(F.when(F.col("id") % 2 == 0, "block").otherwise("allow").alias("verdict"), F.concat(F.lit("H"), "id", F.lit(".net")).alias("host"), F.lit("/p/").alias("path"))
    names = urls.written(rules, 1 << 20)
    assert int(names[0]) == 16 and len(names) > 1
    pages = spark.range(0, 300_600, 7).select(F.col("id").alias("page_id"), F.concat(F.lit("https://w.h"), "id", F.lit(".NET/p/x")).alias("url"))
    got = urls.judged(pages, rules, max_bytes=1 << 20).select("page_id", "rule", "verdict").collect()
    assert all((r["rule"], r["verdict"]) == ((f"h{r['page_id']}.net/p/", "allow" if r["page_id"] % 2 else "block") if r["page_id"] < 300_000 else (None, "allow")) for r in got) and len(got) == 42_943


# ---- toxicity


def corpus(n=500, seed=3):
    r = random.Random(seed)
    good, bad = [f"word{k}" for k in range(200)], ["vilest", "scumlike", "idiotic", "scummy", "idiots"]
    rows, labels = [], []
    for k in range(n):
        sentences = [" ".join(r.choice(good) for _ in range(r.randrange(3, 12))) for _ in range(r.randrange(1, 15))]
        toxic = k % 6 == 0
        if toxic:
            at = r.randrange(len(sentences))
            sentences[at] += " " + r.choice(bad)
        rows.append((k, ". ".join(sentences) + "."))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_toxicity(spark, docs_of):
    rows, labels = corpus()
    rows += [(None, None), (9000, ""), (9001, "\n.!"), (7, rows[7][1])]
    lab = spark.createDataFrame(labels + [(None, 1, 1), (77777, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    d = docs_of(rows).withColumn("score", F.lit(1)).withColumn("toxic", F.lit("x")).withColumn("lid", F.lit(0))
    got = toxicity.score(d, lab).collect()
    assert len(got) == len(rows)
    truth = {i: t for i, _, t in labels}
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([a == b for a, b in held]) > 0.97 and len(held) > 60
    assert {r["predicted"] for r in got if r["doc_id"] in (None, 9000, 9001)} == {0}
    # Labels of held-out rows make no difference.
    flipped = lab.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted((r["doc_id"] or -1, r["score"]) for r in toxicity.score(d, flipped).collect()) == sorted((r["doc_id"] or -1, r["score"]) for r in got)


def test_offending_sentences(spark, docs_of):
    rows, labels = corpus()
    d = docs_of(rows)
    model = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = toxicity.offending(d, model).collect()
    toxic = {i for i, _, t in labels if t}
    assert len({r["doc_id"] for r in found} & toxic) > 0.9 * len(toxic) and all(any(b in r["sentence"] for b in ("vilest", "scum", "idiot")) for r in found if r["doc_id"] in toxic)
    kept = toxicity.keep_clean(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} >= {i for i, _, t in labels if not t}


@pytest.mark.parametrize(("samples", "want"), [([], 0.0), ([("a", 1)], 0.5), ([("a", 0)] * 8, 0.05)])
def test_nothing_to_learn(samples, want):
    assert toxicity.fit(samples).score("any text") == pytest.approx(want)


def test_no_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.score(docs_of([(1, "a")]), none).collect()] == [0.0]
    assert toxicity.score(docs_of([]), none).count() == 0


def test_model_matches_its_sentences():
    m = toxicity.Model({"bad": 9.0, "evil*": 7.0}, -8.0)
    p = [s[1] for s in m.sentences("A bad one. Fine here.\nEvilish bad")]
    assert m.score("A bad one. Fine here.\nEvilish bad") == pytest.approx(1 - np.prod([1 - x for x in p]))


# ---- packing


def plain_best_fit(sizes, length):
    rows, room = [], []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = [(room[r], r) for r in range(len(rows)) if room[r] >= sizes[k]]
        if fits:
            least = min(f[0] for f in fits)
            r = next(r for c, r in fits if c == least)
        else:
            r = len(rows)
            rows.append([])
            room.append(length)
        rows[r].append(k)
        room[r] -= sizes[k]
    return rows, room


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_decreasing(seed):
    r = random.Random(seed)
    length = r.choice([7, 64, 100])
    sizes = [r.randrange(1, length + 1) for _ in range(300)]
    got, (want, room) = packing.best_fit_decreasing(np.array(sizes), length), plain_best_fit(sizes, length)
    # Rows of equal room are as good as each other, so what is left over in all rows must agree.
    assert sorted(length - sum(sizes[k] for k in row) for row in got) == sorted(room) and len(got) == len(want)
    assert sorted(k for row in got for k in row) == list(range(300))


def packed_texts(rows, length):
    """(doc_id, ids) of each document, put together again from its pieces; every row's own invariants hold."""
    parts, got = {}, Counter()
    for r in rows:
        ids, place, cu = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["positions"], "<u2"), r["cu_seqlens"]
        assert len(ids) == len(place) == length and cu[-1] == r["n_tokens"] and not ids[cu[-1] :].any() and not place[cu[-1] :].any()
        for k, (a, z) in enumerate(zip(cu, cu[1:], strict=False)):
            assert place[a:z].tolist() == list(range(z - a))
            parts.setdefault(r["doc_ids"][k], []).append((r["starts"][k], ids[a:z].tolist()))
    for i, segments in parts.items():
        segments.sort()
        while segments:  # from each start on, pieces follow each other
            at = next(k for k, s in enumerate(segments) if s[0] == 0)
            whole = segments.pop(at)[1]
            while whole[-1] != packing.END:
                at = next(k for k, s in enumerate(segments) if s[0] == len(whole))
                whole = whole + segments.pop(at)[1]
            got[i, tuple(whole)] += 1
    return got


def test_packing(docs_of, tmp_path):
    rows = [(k, f"Some text {k} " * (k % 40)) for k in range(150)] + [(1000, "long " * 3000), (1001, None), (None, "no id"), (5, "twice"), (5, "twice")]
    length = 256
    d = docs_of(rows).withColumn("ids", F.lit(1)).withColumn("pack", F.lit(2)).coalesce(1)
    p = packing.packed(d, length=length, together=50).cache()
    own = packing.encoding(packing.vocabulary_path())
    found = p.collect()
    want = Counter((i, tuple(own.encode_ordinary(t or "") + [packing.END])) for i, t in rows)
    assert packed_texts(found, length) == want
    assert sum(r["n_tokens"] for r in found) / len(found) / length > 0.9
    assert sorted((r["pack"], r["row"]) for r in found) == sorted({(r["pack"], r["row"]) for r in found})
    for manifest in (packing.write_binary(p, f"file://{tmp_path}/a").cache(), packing.write_packed(d, f"file://{tmp_path}/a", length=length, together=50).cache()):
        for r in manifest.collect():
            matrix = np.fromfile(tmp_path / "a" / f"{r['shard']}.ids", "<u2").reshape(-1, length)
            assert [m.tobytes() for m in matrix] == [x["ids"] for x in found] and len(matrix) == r["rows"]
        again = packing.read_binary(manifest, f"file://{tmp_path}/a", length=length).collect()
        assert sorted(again) == sorted(found) and len(again) == len(found)
    none = docs_of([])
    assert packing.packed(none).count() == packing.write_packed(none, f"file://{tmp_path}/none").count() == 0


def test_equal_rows_stay_in_bounded_packs(docs_of):
    rows = packing.packed(docs_of([(1, "the same words again and again " * 40)] * 5000 + [(2, "w " * 300_000)]), together=100).collect()
    held = Counter()
    for r in rows:
        if r["n_tokens"] < packing.LENGTH or len(r["doc_ids"]) > 1:
            held[r["pack"]] += len(r["doc_ids"])
    assert max(held.values()) <= 101 and sum(r["doc_ids"].count(1) for r in rows) == 5000


def test_packing_query(spark, small):
    found = packing.query(spark, small).collect()
    p = packing.packed(spark.read.parquet(f"{small}/documents.parquet")).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    key = lambda r: (r["pack"], r["row"])
    assert [(key(r), r["ids_sha256"], r["positions_sha256"], r["cu_seqlens"], r["doc_ids"], r["starts"]) for r in sorted(found, key=key)] == [(key(r), sha(r["ids"]), sha(r["positions"]), r["cu_seqlens"], r["doc_ids"], r["starts"]) for r in sorted(p, key=key)]
    own = packing.encoding(packing.vocabulary_path())
    want = Counter((r["doc_id"], tuple(own.encode_ordinary(r["text"] or "") + [packing.END])) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    assert packed_texts(p, packing.LENGTH) == want


def test_decoding_gives_the_text_back(docs_of):
    own = packing.encoding(packing.vocabulary_path())
    r = packing.packed(docs_of([(1, "Ünïcode 🙂 text\n\n x")]), length=512).first()
    ids = np.frombuffer(r["ids"], "<u2")[: r["n_tokens"]].tolist()
    assert ids[-1] == packing.END and own.decode(ids[:-1]) == "Ünïcode 🙂 text\n\n x"


def test_toxicity_of_balanced_labels():
    for clean in (1, 3):
        samples = [(f"plain words of text {k % 7}. " + ("You vilest scum. " if k % 4 >= clean else "Fine day. "), int(k % 4 >= clean)) for k in range(400)]
        model = toxicity.fit(samples)
        assert model.score("Some text. You vilest scum.") > 0.5 > model.score("Some text. Fine day.")


def test_toxicity_skips_a_text_over_the_bound(spark, docs_of):
    rows = [(k, "x" * 5000 if k % 2 else "You vilest scum." if k % 4 else "Fine day.") for k in range(200)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 2)) for k, _ in rows], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs_of(rows), labels, max_chars=4000).weights
