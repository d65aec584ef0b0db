"""Lexical scores against SQLite's own index, vectors against NumPy, fusion and context by hand."""

import re
import sqlite3
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import vectors as V
from spindrift.models import EchoGenerator, HashEmbedder
from spindrift.operators import answers as A
from spindrift.operators import ann, fusion, lexical, pairs, semantic
from spindrift.plans import search
from spindrift.profiles import CHUNK_PLACES, POSTGRES, SQLITE
from spindrift.sources import index

CHUNKS = [(1, "Rente Rente steigt", "Müller"), (2, "Haushalt Verteidigung Rente eins zwei drei", ""), (3, "Wohnung Miete", ""), (4, "die Rente", "Klingbeil"), (5, "Miete", "Rente Müller")]


def chunks(spark, rows=CHUNKS):
    return spark.createDataFrame(rows, "chunk_id long, text string, redner string")


def test_bm25_matches_sqlite(spark):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(text, redner, tokenize = 'unicode61 remove_diacritics 2')")
    db.executemany("insert into f(rowid, text, redner) values (?, ?, ?)", CHUNKS)
    want = {r[0]: -r[1] for r in db.execute("""select rowid, bm25(f, 1.0, 0.5) from f where f match '"Miete" OR "muller"'""")}
    asked = spark.createDataFrame([("miete",), ("muller",)], "term string")
    got = {r["chunk_id"]: r["score"] for r in lexical.bm25(chunks(spark), asked).collect()}
    assert got == pytest.approx(want, abs=1e-9) and len(got) == 3


def test_bm25_matches_sqlite_on_documents(spark, small):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(text, redner, tokenize = 'unicode61 remove_diacritics 2')")
    db.executemany("insert into f(rowid, text, redner) values (?, ?, ?)", rows)
    words = ["the", "que", "src3", "thonre"]
    want = {r[0]: -r[1] for r in db.execute(f"select rowid, bm25(f, 1.0, 0.5) from f where f match '{' OR '.join(words)}'")}
    got = {r["chunk_id"]: r["score"] for r in lexical.bm25(chunks(spark, rows), spark.createDataFrame([(w,) for w in words], "term string")).collect()}
    assert got == pytest.approx(want, abs=1e-9) and got


def test_cut_frequent(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "term string")
    df = spark.createDataFrame([("a", 5), ("b", 50)], "term string, ndoc long")
    cut = lambda most: sorted(r["term"] for r in lexical.cut_frequent(asked, df, most).collect())
    assert cut(10) == ["a", "c"] and cut(-1) == ["a", "b", "c"] and cut(100) == ["a", "b", "c"]


def test_vectors(spark):
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(50, 8)), rng.normal(size=8)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(99, [0.0] * 8), (98, None)], "vec_id long, embedding array<double>")
    l2 = [r["vec_id"] for r in semantic.nearest(df, q.tolist(), 5, "l2").collect()]
    assert l2 == [k if k < 50 else 99 for k in np.argsort(np.linalg.norm(np.vstack([x, np.zeros((1, 8))]) - q, axis=1))[:5]]
    cos = [r["vec_id"] for r in semantic.nearest(df, q.tolist(), 5).collect()]
    assert cos == np.argsort(1 - x @ q / np.linalg.norm(x, axis=1))[:5].tolist()
    values = [*rng.normal(size=200).tolist(), 0.0, 1.0, -2.5, 6.1e-5, 1e-7, 65000.0]
    halved = spark.createDataFrame([(values,)], "v array<double>").select(V.to_half(F.col("v"))).first()[0]
    assert halved == V.half(values)
    assert V.literal([0.123456789, 1.0, -2e-7]) == "[0.123457,1,-2e-07]"


def test_fuse(spark):
    a = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "chunk_id long, rank int")
    b = spark.createDataFrame([(1, 1), (4, 2)], "chunk_id long, rank int")
    rows = fusion.fuse({"bm25": (a, 1.0), "vektor": (b, 1.5)}, 10).orderBy("rank").collect()
    assert rows[0]["score"] == pytest.approx(2.5 / 61) and rows[0]["found_by"] == ["bm25", "vektor"]
    ties = fusion.fuse({"bm25": (a, 1.0), "vektor": (b.where("chunk_id = 4"), 1.0)}, 10).orderBy("rank").collect()
    assert [r["chunk_id"] for r in ties] == [1, 2, 4, 3]


def test_neighbours(spark):
    c = spark.createDataFrame([(10 * d + p, d, p) for d in (1, 2) for p in range(5)], "chunk_id long, document_id long, position int")
    hits = spark.createDataFrame([(12, 1), (14, 2), (20, 3)], "chunk_id long, rank int")
    got = [r["chunk_id"] for r in fusion.with_neighbours(hits, c).orderBy("ord").collect()]
    assert got == [12, 11, 13, 14, 20, 21]
    assert [r["chunk_id"] for r in fusion.with_neighbours(hits, c, order="appended").orderBy("ord").collect()] == [12, 14, 20, 11, 13, 21]
    assert [r["chunk_id"] for r in fusion.with_neighbours(hits, c, 0).orderBy("ord").collect()] == [12, 14, 20]


def test_context_skips(spark):
    sizes = [5, 9, 3, 4, 2]
    hits = spark.createDataFrame([(k, "", "x" * n) for k, n in enumerate(sizes)], "ord int, head string, body string")
    row = fusion.build_context(hits, 8 + 5, 10 + 15).first()
    assert [len(q["block"]) - 5 for q in row["quellen"]] == [5, 3, 2] and [q["nummer"] for q in row["quellen"]] == [1, 2, 3]
    assert row["context"].count("\n\n---\n\n") == 2


@pytest.mark.parametrize(("answer", "want"), [("[3, 1]", [13, 11, 12]), ("nichts", [11, 12, 13]), ("[9]", [11, 12, 13]), ("[2, 2]", [12, 12, 11]), ('["a", 2]', [12, 11, 13]), ("[2.5, 2]", [12, 11, 13]), ('["3", 2]', [12, 11, 13]), ("[a, 2]", [11, 12, 13]), ("[99999999999999, 3]", [13, 11, 12]), ("[]", [11, 12, 13]), ("[[4]]", [11, 12, 13])])
def test_rerank(spark, answer, want):
    c = spark.createDataFrame([(10 + k, k) for k in range(1, 6)], "chunk_id long, rank int")
    got = [r["chunk_id"] for r in fusion.rerank(c, answer, 3).orderBy("ord").collect()]
    assert got == want
    assert [r["chunk_id"] for r in fusion.rerank(c.where("rank < 3"), "[2]", 3).orderBy("ord").collect()] == [11, 12]


def column(spark, c):
    return spark.range(1).select(c.alias("c")).first()["c"]


def test_answers(spark):
    lit = F.lit
    assert tuple(column(spark, A.split_answer(lit(" a @@@ b ")))) == ("a", "b")
    assert tuple(column(spark, A.split_answer(lit("  a "), True))) == ("a ", "")
    assert tuple(column(spark, A.split_answer(lit("  a ")))) == ("", "a")
    assert column(spark, A.fill(lit("{a} {b} {a}"), {"a": lit("$1{b}"), "b": lit("x")})) == "$1x {b} {a}"
    parts = F.array(F.struct(lit("x").alias("text"), lit(True).alias("thought")), F.struct(lit("y").alias("text"), lit(None).cast("boolean").alias("thought")))
    assert column(spark, A.visible_text(parts)) == "y"
    runs = column(spark, A.marked_runs(lit("a\u0001b\u0002c")))
    assert [(r["text"], r["marked"]) for r in runs] == [("a", False), ("b", True), ("c", False)]
    assert column(spark, A.language(lit("xx"))) == "de" and column(spark, A.language(lit("en"))) == "en"
    assert column(spark, fusion.mark_sentence(lit("a b c"), lit("b"))) == "a \u0001b\u0002 c"
    label = fusion.source_label(lit("Drucksache"), lit("21/1"), lit("2025-01-02"), lit("A"), lit("Minister"), lit(""), lit(""))
    assert column(spark, label) == "Drucksache 21/1 vom 2025-01-02, A (Minister)"


def test_ask(spark, tmp_path):
    rows = [(k // 3 * CHUNK_PLACES + k % 3, k // 3, k % 3, f"Text Nummer {k} über Rente und Miete steht hier.", None, None, None, "21/1", "Drucksache", None, "Titel", "2025-01-01") for k in range(9)]
    schema = "chunk_id long, document_id long, position int, text string, redner string, rolle string, fraktion string, dokumentnummer string, dokumentart string, drucksachetyp string, titel string, datum string"
    c = spark.createDataFrame(rows, schema).withColumn("datum", F.col("datum").cast("date"))
    embedder = HashEmbedder(32)
    v = spark.createDataFrame([(r[0], embedder.embed([r[3]])[0], r[8]) for r in rows], "chunk_id long, embedding array<double>, dokumentart string")
    index.write(c, str(tmp_path / "index"), 4)
    own = index.read(spark, str(tmp_path / "index"))
    for profile, held in ((SQLITE, None), (POSTGRES, None), (SQLITE, own), (POSTGRES, own)):
        model = EchoGenerator(['{"suchbegriffe": "Renten", "dokumentart": "Drucksache"}' if profile is POSTGRES else '{"suchbegriffe": "Rente", "dokumentart": "Drucksache"}', "Ja [1]."])
        events = list(search.ask(c, v, "Was ist mit der Rente?", model, embedder, "{frage}", "{frage}{kontext}", profile, index=held))
        assert [e["typ"] for e in events] == ["analyse", "quellen", "text", "text", "fertig"] and len(events[1]["quellen"]) == 9
        first = events[1]["quellen"][0]
        assert first["quelle"] == "Drucksache 21/1 vom 2025-01-01" and first["titel"] == "Titel" and first["datum"] == "2025-01-01"
        assert all(q["auszug"].startswith(fusion.MARK_ON) and q["auszug"].endswith(fusion.MARK_OFF) for q in events[1]["quellen"])
    none = list(search.ask(c, None, "Xyz", EchoGenerator(["kein JSON"]), None, "{frage}", "", SQLITE, language="xx"))
    assert [e["typ"] for e in none] == ["analyse", "text", "fertig"] and none[1]["text"] == search.NO_HITS["de"]
    assert [e["typ"] for e in search.ask(c, None, "  ", EchoGenerator(), None, "", "", SQLITE)] == ["fehler"]
    picked = EchoGenerator(["kein JSON", "Am besten [3, 1].", "Ja."])
    events = list(search.ask(c, v, "Rente", picked, embedder, "{frage}", "{kontext}", SQLITE, limit=2, rerank_template="{anzahl} aus {kandidaten}"))
    assert events[1]["typ"] == "quellen" and len(events[1]["quellen"]) >= 2

    class Broken(EchoGenerator):
        def complete(self, prompt, temperature=0.0):
            raise OSError("aus")

    assert list(search.ask(c, v, "Rente", Broken(), None, "{frage}", "", SQLITE))[-1] == {"typ": "fehler", "meldung": "aus"}


PAPERS = ["Die Mietpreise steigen weiter an.", "Der Mietpreis und die Mieten.", "Wie ist die Lage der Rentner?", "Die Rente ist sicher, die Renten steigen.", "Nichts davon."]


def papers(spark):
    rows = [(k * CHUNK_PLACES, k, 0, t, None, "D") for k, t in enumerate(PAPERS)]
    return spark.createDataFrame(rows, "chunk_id long, document_id long, position int, text string, redner string, dokumentart string")


def test_stems_find_other_forms(spark, tmp_path):
    c = papers(spark)
    index.write(c, str(tmp_path / "i"), 3)
    uncut = replace(POSTGRES, max_df=None)
    for own in (None, index.read(spark, str(tmp_path / "i"))):
        found = lambda q, p=uncut: [(r["chunk_id"] // CHUNK_PLACES, round(r["score"], 3)) for r in search.lexical_hits(c, search.asked(spark, q, p), p, index=own).orderBy("rank").collect()]  # noqa: E731, B023
        assert found("Mietpreisen") == [(0, 0.1), (1, 0.1)]
        # Stopwords find nothing, however often they occur.
        assert found("Wie ist die Rente?") == [(3, 0.2)] and found("die") == []
        # A stem in more than the share of chunks does not count, unless all are that frequent.
        assert found("steigen Rentner", replace(POSTGRES, max_df=0.3)) == [(2, 0.1)]
        assert found("steigen", replace(POSTGRES, max_df=0.3)) == [(0, 0.1), (3, 0.1)]


def test_index_gives_the_scores_of_the_texts(spark, small, tmp_path):
    from spindrift.plans.queries_retrieval import chunks as lines

    c = lines(spark, small)
    index.write(c, str(tmp_path / "i"), 7)
    own = index.read(spark, str(tmp_path / "i"))
    for profile in (SQLITE, POSTGRES):
        for q in ("the que and src3", "thonre is anly Die", ""):
            asked = search.asked(spark, q, profile)
            rows = lambda held: [(r["chunk_id"], round(r["score"], 9)) for r in search.lexical_hits(c, asked, profile, F.col("document_id") % 2 == 0, held).orderBy("rank").collect()]  # noqa: E731, B023
            assert rows(None) == rows(own)
    assert {r["document_id"] for r in own.of_documents([3, 5, 10**12]).collect()} == {3, 5}
    assert own.of_documents([3]).count() == c.where("document_id = 3").count()
    plan = own.of_terms(own.postings, ["the"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*\(bucket#", plan) and "PushedFilters: [IsNotNull(term), EqualTo(term,the)]" in plan


def test_batch_is_a_search_for_each(spark, tmp_path):
    c, embedder = papers(spark), HashEmbedder(16)
    v = spark.createDataFrame([(k * CHUNK_PLACES, embedder.embed([t])[0]) for k, t in enumerate(PAPERS)], "chunk_id long, embedding array<double>")
    index.write(c, str(tmp_path / "i"), 3)
    asked = [(0, "Mietpreise Rente"), (1, "steigen"), (2, "fehlt")]
    questions = spark.createDataFrame([(k, q, embedder.embed([q])[0]) for k, q in asked], "frage_id int, suchbegriffe string, vektor array<double>")
    for profile in (SQLITE, POSTGRES):
        for own in (None, index.read(spark, str(tmp_path / "i"))):
            got = {(r["frage_id"], r["chunk_id"]): (r["rank"], round(r["score"], 9)) for r in search.batch(c, v, questions, profile, 4, own).collect()}
            want = {}
            for k, q in asked:
                for r in search.hybrid(c, v, search.asked(spark, q, profile), embedder.embed([q])[0], profile, limit=4, index=own).collect():
                    want[k, r["chunk_id"]] = (r["rank"], round(r["score"], 9))
            assert got == want


def test_candidate_lines(spark):
    c = spark.createDataFrame([(1, None, "Drucksache", "21/1", "a \n\t b" + "c" * 300), (2, "Antrag", "Drucksache", "21/2", None), (99, "x", "y", "z", "w")], "rank int, drucksachetyp string, dokumentart string, dokumentnummer string, text string")
    assert fusion.candidate_lines(c).first()["kandidaten"] == "1. [Drucksache 21/1] a b" + "c" * 197 + "\n2. [Antrag 21/2] "


def test_many_hits_are_pinned(spark):
    hits = spark.range(50).select(F.col("id").alias("chunk_id"), F.col("id").cast("int").alias("rank"))
    assert fusion.pinned(hits, 10).count() == 50 and sorted(map(tuple, fusion.pinned(hits).collect())) == [(k, k) for k in range(50)]


def test_queries_in_blocks(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 6))
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    q = v.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    whole, blocks = (sorted(map(tuple, semantic.nearest_per_query(v, q, 4, block=b).collect())) for b in (1000, 7))
    assert whole == blocks and len(whole) == 80


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_tiles_of_queries_and_rows(spark, monkeypatch, metric):
    """Against all pairs by Spark's columns: copies, ties by id, vectors without a length or of other dimensions, and numbers that are none."""
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(40, 6)), 4, axis=0)
    rows = [(k, r.tolist()) for k, r in enumerate(x)]
    rows += [(500, None), (501, []), (502, [0.0] * 6), (503, [1.0, None] * 3), (504, [1.0] * 5), (505, [2.0] * 5), (506, [float("nan")] * 6), (507, [float("inf")] + [1.0] * 5), (508, [1e200] * 6), (509, [1e-200] * 6)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    monkeypatch.setattr(pairs, "TILE_BYTES", 8 * 6 * 20)
    measure = V.l2_distance if metric == "l2" else V.cosine_distance
    for places, other, limit in ((None, False, 5), (9, True, 7), (1, False, 3), (2, True, 300)):
        measured = measure(F.col("embedding"), F.col("q"))
        near = v.join(q).where("vec_id <> query_id" if other else "true").select("query_id", "vec_id", (measured if places is None else F.round(measured, places)).alias("distance")).where("distance is not null")
        want = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).where(F.col("rank") <= limit)
        key = lambda r: (r["query_id"], r["rank"], r["vec_id"], repr(r["distance"]))
        got = semantic.nearest_per_query(v, q, limit, metric, places=places, other=other)
        assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
        # Pairs meet in the tiles and are no rows of the plan.
        assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
    whole = pairs.tile_nearest(x[::7], x, np.arange(160), 5, metric, 0.0)
    monkeypatch.setattr(pairs, "PRODUCT", 50)
    strips = pairs.tile_nearest(x[::7], x, np.arange(160), 5, metric, 0.0)
    assert len(whole[0]) == 5 * len(x[::7]) and all((a == b).all() for a, b in zip(whole, strips, strict=True))


def test_batches_are_bounded_once_rows_are_repeated():
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000))], names=["k"])
    parts = list(ann._slices(batch, 300, 64))
    assert sum(b.num_rows for b in parts) == 10_000 and max(b.num_rows for b in parts) * 300 * 64 * 8 <= ann._BATCH


def test_recall_of_nothing_is_reported(spark):
    from spindrift.plans.queries_retrieval import recall

    exact = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 12)], "query_id long, vec_id long")
    found = spark.createDataFrame([(1, 10), (1, 12), (2, 13), (2, 14)], "query_id long, vec_id long")
    assert {r["query_id"]: r["recall"] for r in recall(exact, found, 2).collect()} == {1: 0.5, 2: 0.0}


def test_every_20th_vector_is_asked(spark, small):
    from spindrift.plans.catalogue import load

    want = {r["vec_id"] for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id").collect() if r["vec_id"] % 20 == 0}
    for name, column in (("knn_half_recall", "query_id"), ("knn_batch_per_query", "query_id"), ("eval_hit_at_k", "frage_id")):
        assert {r[column] for r in load()[name].run(spark, small).select(column).collect()} == want


def test_cells_find_most_neighbours(spark):
    """Recall against the exact search, over all vectors of the largest test table; every vector is indexed."""
    from spindrift.plans.catalogue import load

    rows = load()["knn_cells_recall"].run(spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == 100 and sum(r["recall"] for r in rows) / len(rows) >= 0.9


def test_cells(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 12))
    rows = [(k, r.tolist()) for k, r in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 12), (5, x[5].tolist())]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("centre", F.lit(1))
    ann.write(v, str(tmp_path / "c"), 9)
    own = ann.read(spark, str(tmp_path / "c"))
    assert own.vectors.count() == len(rows) and own.vectors.where("cell = -1").count() == 2 and len(own.centres) == 9
    # With all cells it is the exact search.
    for metric in ("cosine", "l2"):
        got = [(r["vec_id"], round(r["distance"], 9)) for r in ann.nearest(own, x[7].tolist(), 10, metric, probes=9).collect()]
        assert got == [(r["vec_id"], round(r["distance"], 9)) for r in semantic.nearest(v, x[7].tolist(), 10, metric).collect()]
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    whole = sorted((r["query_id"], r["vec_id"], r["rank"]) for r in ann.nearest_per_query(own, q, 4, probes=9).collect())
    assert whole == sorted((r["query_id"], r["vec_id"], r["rank"]) for r in semantic.nearest_per_query(v, q, 4).collect())
    few = ann.nearest(own, x[7].tolist(), 1, probes=1)
    assert few.first()["vec_id"] == 7 and re.search(r"PartitionFilters: \[[^]]*cell#", few._jdf.queryExecution().executedPlan().toString())
    ann.write(v.where("false"), str(tmp_path / "none"))
    assert ann.nearest(ann.read(spark, str(tmp_path / "none")), [1.0], 3).count() == 0


def test_stems_and_cut_by_hand(spark, small):
    """``postgres_topk`` against plain Python over all lines: stems of words that are no stopwords, those of too many lines left out."""
    from collections import Counter

    from spindrift.functions import german
    from spindrift.plans.catalogue import load

    stop = set(german.stopwords(spark))
    words = lambda t: [german.stem(w) for w in re.findall(r"[^\W_]+", (t or "").lower()) if w not in stop]
    lines = {r["doc_id"] * CHUNK_PLACES + k: Counter(words(t) + words(r["source"])) for r in spark.read.parquet(f"{small}/documents.parquet").collect() for k, t in enumerate(r["text"].split("\n"))}
    question = min(spark.read.parquet(f"{small}/benchmark.parquet").collect(), key=lambda r: r["item_id"])["text"]
    asked = list(dict.fromkeys(german.stem(w.lower()) for w in re.findall(r"[^\W_]{2,}", question)[:32] if w.lower() not in stop))
    held = {s: sum(s in c for c in lines.values()) for s in asked}
    rare = [s for s in asked if held[s] <= POSTGRES.max_df * len(lines)] or asked
    scores = {k: 0.1 * sum(c[s] for s in rare) for k, c in lines.items() if any(s in c for s in rare)}
    want = [(k, round(v, 6), n + 1) for n, (k, v) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:40])]
    assert [tuple(r) for r in load()["postgres_topk"].run(spark, small).orderBy("rank").collect()] == want and want


def test_half_recall_by_hand(spark, small):
    from spindrift.plans.catalogue import load

    rows = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=float)
    half = x.astype(np.float16).astype(float)
    want = {}
    for k in np.flatnonzero(ids % 20 == 0):
        near = [set(ids[np.lexsort((ids, 1 - v @ x[k] / np.linalg.norm(v, axis=1) / np.linalg.norm(x[k])))[:10]].tolist()) for v in (x, half)]
        want[int(ids[k])] = len(near[0] & near[1]) / 10
    assert {r["query_id"]: r["recall"] for r in load()["knn_half_recall"].run(spark, small).collect()} == want


def test_terms_and_candidates_of_an_evaluation(spark):
    from spindrift.operators import evaluation as E

    rows = spark.createDataFrame([(1, " a  b\u00a0a\n"), (2, ""), (3, None)], "k int, w string").select("k", E.search_terms(F.col("w")).alias("t")).collect()
    assert {r["k"]: r["t"] for r in rows} == {1: ["a", "b", "a"], 2: [], 3: []}
    ranked = spark.createDataFrame([(1, 11, 2), (1, 12, 1), (2, 99, 1)], "frage_id int, chunk_id long, rank int")
    held = spark.createDataFrame([(11, 1, "x" * 300), (12, 5, "y"), (99, 1, None)], "chunk_id long, document_id long, text string")
    docs = spark.createDataFrame([(1, "21/1", "Drucksache", None, "T")], "id long, dokumentnummer string, dokumentart string, drucksachetyp string, titel string")
    got = sorted(map(tuple, E.candidate_rows(ranked, held, docs, 5).collect()))
    assert got == [(1, 2, 11, "21/1", "Drucksache", None, "xxxxx", "T"), (2, 1, 99, "21/1", "Drucksache", None, None, "T")]


def test_no_token_is_shuffled(spark, small):
    """Texts are dealt once by chunk: postings of all of them are counted where they are cut."""
    from spindrift.plans.catalogue import load

    plan = load()["postings"].run(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(chunk_id" in plan and "hashpartitioning(term" not in plan


def test_one_question_writes_no_index(spark, small, tmp_path):
    """Without an index the texts answer, with the rows that an index gives; of the texts' own scores both uses are one shuffle."""
    import os
    import shutil

    from spindrift.operators import lexical
    from spindrift.plans import queries_retrieval as R
    from spindrift.plans.catalogue import load
    from spindrift.shipping import listed, shared_folder

    sf = str(tmp_path / "sf")
    os.mkdir(sf)
    for t in ("benchmark", "embeddings"):
        shutil.copy(f"{small}/{t}.parquet", sf)
    spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 60").write.parquet(f"{sf}/documents.parquet")
    names = ("rrf_unweighted", "eval_hybrid", "postgres_topk", "rerank_backfill", "hybrid_context", "neighbours_appended")
    rows = lambda: {n: sorted(map(repr, load()[n].run(spark, sf).collect())) for n in names}
    before = listed(spark, shared_folder(spark), "lines-")
    without = rows()
    assert listed(spark, shared_folder(spark), "lines-") == before and all(without.values())
    R.stored(spark, sf)
    assert len(listed(spark, shared_folder(spark), "lines-")) == len(before) + 1
    assert rows() == without
    scores = lexical.bm25(R.chunks(spark, sf), R.terms(spark, sf))
    scores.collect()
    assert "ReusedExchange" in scores._jdf.queryExecution().executedPlan().toString()
