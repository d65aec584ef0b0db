"""The jobs over one store, from raw records to an evaluation; German stems."""

import json

import pytest
from pyspark.sql import functions as F

from spindrift import jobs
from spindrift.functions import german
from spindrift.models import EchoGenerator, HashEmbedder
from spindrift.operators import lexical, maintenance, segment
from spindrift.profiles import CHUNK_PLACES, PROFILES
from spindrift.sources import index as stored_index
from spindrift.sources import tables

WORDS = ["Rente", "Miete", "Haushalt", "Verteidigung"]


def record(k, version="a", more=""):
    w = WORDS[k % 4]
    return {"id": str(k), "dokumentart": "Drucksache", "dokumentnummer": f"21/{k}", "titel": f"{w} {k}", "datum": "2025-01-01", "aktualisiert": version, "text": f"Der Antrag {k} befasst sich mit {w}. " * 40 + more}


def test_life_of_a_store(spark, tmp_path):
    raw, store = str(tmp_path / "raw"), str(tmp_path / "store")
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "1.jsonl").write_text("\n".join(json.dumps(record(k)) for k in range(8)) + "\n" + json.dumps({"id": "9", "titel": "ohne Text"}))
    jobs.build(spark, raw, store)
    jobs.embed(spark, store, HashEmbedder(64), 5)
    first = jobs.stats(spark, store)
    assert first["documents"] == 9 and first["ohne_volltext"] == 1 and first["gechunkt"] == 8 and first["vektoren"] == 5 == first["chunks_mit_embedding"]
    jobs.embed(spark, store, HashEmbedder(64))
    assert jobs.stats(spark, store)["vektoren"] == first["chunks"]
    # A second harvest changes one document, and only that one is cut anew.
    (tmp_path / "raw" / "2.jsonl").write_text(json.dumps(record(2, "b", "Neu ist der Absatz am Ende, der hier steht.")))
    before = {r["chunk_id"]: r["text"] for r in tables.load(spark, f"{store}/chunks").collect()}
    jobs.publish(spark, store, str(tmp_path / "serving"))
    jobs.build(spark, raw, store)
    after = {r["chunk_id"]: r["text"] for r in tables.load(spark, f"{store}/chunks").collect()}
    assert {k // CHUNK_PLACES for k in {**before, **after} if before.get(k) != after.get(k)} == {2}
    assert jobs.stats(spark, store)["vektoren"] < len(after)
    assert [tuple(r) for r in jobs.resync(spark, store, str(tmp_path / "serving")).collect()] == [(2, "replace")]
    jobs.publish(spark, store, str(tmp_path / "serving"))
    assert jobs.resync(spark, store, str(tmp_path / "serving")).count() == 0
    jobs.embed(spark, store, HashEmbedder(64))
    rows = jobs.search(spark, store, "Wie steht es um die Miete?", HashEmbedder(64), 4, dokumentart="Drucksache").collect()
    assert rows and all("Miete" in r["text"] for r in rows[:2]) and "bm25" in rows[0]["found_by"]
    (tmp_path / "q.json").write_text(json.dumps({"fragen": [{"frage": "Rente", "ziele": ["21/0", "21/4"], "art": "antrag"}, {"frage": "x", "ziele": [], "art": "negativ"}]}))
    assert jobs.evaluate(spark, store, str(tmp_path / "q.json"), HashEmbedder(64)).startswith("Treffer: 1/1")
    assert jobs.index_of(spark, store) is None
    jobs.index(spark, store, 4)
    own = jobs.index_of(spark, store)
    assert own.of_terms(own.frequency, ["miete"]).where("kind = 'word'").first()["ndoc"] > 0
    indexed = jobs.search(spark, store, "Wie steht es um die Miete?", HashEmbedder(64), 4, dokumentart="Drucksache").collect()
    assert [(r["chunk_id"], r["rank"], r["text"]) for r in indexed] == [(r["chunk_id"], r["rank"], r["text"]) for r in rows]
    before = jobs.evaluate(spark, store, str(tmp_path / "q.json"), HashEmbedder(64), profile="sqlite").splitlines()
    assert before[0].startswith("Treffer: 1/1") and before[2].startswith("Zeit je Frage")
    assert tables.load(spark, f"{store}/eval_cache").count() == 1
    picked = EchoGenerator(["[1]"] * 3)
    assert jobs.evaluate(spark, store, str(tmp_path / "q.json"), HashEmbedder(64), top_k=2, generator=picked, rerank_template="{frage} {kandidaten}").startswith("Treffer: 1/1")
    events = list(jobs.ask(spark, store, "Miete", EchoGenerator(["kein JSON", "Ja [1]."]), HashEmbedder(64), "{frage}", "{kontext}", limit=2))
    assert events[1]["typ"] == "quellen" and "Miete" in events[1]["quellen"][0]["auszug"]
    # A build that changes nothing writes nothing and leaves the index as it is.
    state = {t: tables.current(spark, f"{store}/{t}") for t in ("chunks", "documents", "vectors", "index/segments", "index/cells/parts")}
    assert jobs.build(spark, raw, store) == 0 and state == {t: tables.current(spark, f"{store}/{t}") for t in state}
    # A newer build adds a segment of what changed, and the search finds it by the index, as by the chunks.
    (tmp_path / "raw" / "3.jsonl").write_text(json.dumps(record(3, "c", "Am Ende steht das Wort Zitrone.")) + "\n" + json.dumps(record(20, "a", "Und die Zitrone.")))
    assert jobs.build(spark, raw, store, kind="drucksache") == 2
    own = jobs.index_of(spark, store)
    assert len(own.segments) == 2 and jobs.cells_of(spark, store) is not None
    compared(spark, store, ["Zitrone", "Verteidigung Miete", "Absatz am Ende"])
    jobs.embed(spark, store, HashEmbedder(64))
    assert jobs.cells_of(spark, store).vectors.count() == jobs.stats(spark, store)["vektoren"] == jobs.stats(spark, store)["chunks"]
    compared(spark, store, ["Zitrone", "Miete"])
    # Many segments become one.
    for k in range(3):
        (tmp_path / "raw" / f"{4 + k}.jsonl").write_text(json.dumps(record(k, f"d{k}", f"Neu {k} Birne.")))
        jobs.build(spark, raw, store)
    assert len(jobs.index_of(spark, store).segments) == 5
    stored_index.compact(spark, f"{store}/index")
    jobs.index(spark, store)
    assert len(jobs.index_of(spark, store).segments) == 1 and stored_index.sweep(spark, f"{store}/index") == [0, 1, 2, 3, 4]
    jobs.embed(spark, store, HashEmbedder(64))
    compared(spark, store, ["Birne", "Zitrone", "Rente"])


def compared(spark, store, questions):
    """What is found by index and cells is what is found without them."""
    own, cells = jobs.index_of, jobs.cells_of
    for q in questions:
        for profile in PROFILES.values():
            found = []
            for without in (False, True):
                if without:
                    jobs.index_of = jobs.cells_of = lambda *_: None
                try:
                    rows = jobs.search(spark, store, q, HashEmbedder(64), 6, profile, dokumentart="Drucksache").collect()
                finally:
                    jobs.index_of, jobs.cells_of = own, cells
                found.append([(r["chunk_id"], round(r["score"], 9), r["text"]) for r in rows])
            assert found[0] == found[1] and found[0]


def test_an_index_that_was_left_behind_catches_up(spark, tmp_path, monkeypatch):
    """The build fails before its index follows, or between tables: no vector is beside another text, the search goes by the chunks, and the next run mends it."""
    raw, store = tmp_path / "raw", str(tmp_path / "store")
    raw.mkdir()
    (raw / "1.jsonl").write_text("\n".join(json.dumps(record(k)) for k in range(6)))
    jobs.build(spark, str(raw), store)
    jobs.embed(spark, store, HashEmbedder(16))
    jobs.index(spark, store, 3)
    whole, parts = tables.replace, tables.replace_buckets
    for k, table in enumerate(("vectors", "chunks", "documents", "index/segments")):
        (raw / f"{k + 2}.jsonl").write_text(json.dumps(record(k, f"v{k}", "Ganz neu ist der Apfel.")) + "\n" + json.dumps(record(50 + k, "a", "Apfel.")))

        def failing(df, folder, *a, table=table):
            if folder == f"{store}/{table}":
                raise OSError("aus")
            return (parts if len(a) == 2 else whole)(df, folder, *a)

        monkeypatch.setattr(tables, "replace", failing)
        monkeypatch.setattr(tables, "replace_buckets", failing)
        with pytest.raises(OSError, match="aus"):
            jobs.build(spark, str(raw), store)
        monkeypatch.setattr(tables, "replace", whole)
        monkeypatch.setattr(tables, "replace_buckets", parts)
        texts = {r["chunk_id"]: r["text"] for r in tables.load(spark, f"{store}/chunks").collect()}
        for r in tables.load(spark, f"{store}/vectors").collect():
            assert r["chunk_id"] in texts and [round(x, 5) for x in r["embedding"]] == [round(x, 5) for x in HashEmbedder(16).embed([texts[r["chunk_id"]]])[0]]
        assert (jobs.index_of(spark, store) is None) == (table != "vectors" and table != "chunks")
        jobs.build(spark, str(raw), store)
        jobs.index(spark, store)
        jobs.embed(spark, store, HashEmbedder(16))
        assert jobs.cells_of(spark, store).vectors.count() == tables.load(spark, f"{store}/chunks").count()
        own, fresh = jobs.index_of(spark, store), {r["chunk_id"]: r["text"] for r in tables.load(spark, f"{store}/chunks").collect()}
        assert {r["chunk_id"]: r["text"] for r in own.chunks.collect()} == fresh and own.count == len(fresh)


def test_publishing_goes_on_where_it_broke_off(spark, tmp_path, monkeypatch):
    raw, store, target = tmp_path / "raw", str(tmp_path / "store"), str(tmp_path / "target")
    raw.mkdir()
    (raw / "1.jsonl").write_text("\n".join(json.dumps(record(k)) for k in range(8)))
    jobs.build(spark, str(raw), store)
    jobs.embed(spark, store, HashEmbedder(16))
    count, whole, calls = tables.load(spark, f"{store}/vectors").count(), tables.append_buckets, []

    def failing(*a):
        calls.append(a)
        if len(calls) == 2:
            raise OSError("aus")
        return whole(*a)

    monkeypatch.setattr(tables, "append_buckets", failing)
    with pytest.raises(OSError, match="aus"):
        jobs.publish(spark, store, target, commit=4)
    monkeypatch.setattr(tables, "append_buckets", whole)
    first = tables.load(spark, f"{target}/vectors").count()
    assert 0 < first < count and jobs.publish(spark, store, target, commit=4) == -(-(count - first) // 4)
    held = [tuple(r) for r in tables.load(spark, f"{target}/vectors").select("chunk_id").collect()]
    assert len(held) == len(set(held)) == count and jobs.publish(spark, store, target) == 0
    hits = jobs.search(spark, target, "Rente", HashEmbedder(16), 4).collect()
    assert any("vektor" in r["found_by"] for r in hits)
    # A changed document: its vectors go with its chunks, and the target's index follows.
    jobs.index(spark, target, 3)
    (raw / "2.jsonl").write_text(json.dumps(record(2, "b", "Neu ist die Quitte.")))
    jobs.build(spark, str(raw), store)
    jobs.publish(spark, store, target)
    assert not [r for r in tables.load(spark, f"{target}/vectors").collect() if r["chunk_id"] // CHUNK_PLACES == 2]
    assert len(jobs.index_of(spark, target).segments) == 2 and "Quitte" in jobs.search(spark, target, "Quitte").first()["text"]


def test_a_build_writes_the_buckets_of_what_changed(spark, tmp_path):
    """Files of other buckets stay as they are and are not listed for a read of some."""
    raw, store = tmp_path / "raw", str(tmp_path / "store")
    raw.mkdir()
    (raw / "1.jsonl").write_text("\n".join(json.dumps(record(k)) for k in range(20)))
    jobs.build(spark, str(raw), store)
    jobs.embed(spark, store, HashEmbedder(8))
    before = {t: tables.current(spark, f"{store}/{t}") for t in ("chunks", "vectors")}
    (raw / "2.jsonl").write_text(json.dumps(record(3, "b", "Neu.")))
    assert jobs.build(spark, str(raw), store) == 1
    bucket = spark.range(1).select(tables.bucket_of(F.lit(3))).first()[0]
    for t in before:
        now = tables.current(spark, f"{store}/{t}")
        assert {v for v in before[t] if v not in now} == {v for v in before[t] if v.endswith(f"/bucket={bucket}")}
        assert {v.split("/")[1] for v in now if v not in before[t]} <= {f"bucket={bucket}"}
    some = tables.load(spark, f"{store}/chunks", [bucket])
    assert {r["document_id"] for r in some.collect()} == {k for k in range(20) if spark.range(1).select(tables.bucket_of(F.lit(k))).first()[0] == bucket}
    assert tables.load(spark, f"{store}/chunks", [bucket + 1000]).count() == 0
    assert len(tables.vacuum(spark, f"{store}/chunks", 0)) == 0 and tables.load(spark, f"{store}/chunks").count() == jobs.stats(spark, store)["chunks"]
    # A table that was written whole becomes one in buckets at the next build.
    tables.replace(tables.load(spark, f"{store}/chunks"), f"{store}/chunks")
    (raw / "3.jsonl").write_text(json.dumps(record(4, "b", "Neu.")))
    count = tables.load(spark, f"{store}/chunks").count()
    jobs.build(spark, str(raw), store)
    assert tables.by_buckets(spark, f"{store}/chunks") and abs(tables.load(spark, f"{store}/chunks").count() - count) <= 1


def test_buckets_without_rows(spark, tmp_path):
    folder, key = str(tmp_path / "t"), F.col("id")
    tables.replace_buckets(spark.range(10), folder, tables.bucket_of(key), range(64))
    tables.append_buckets(spark.range(10, 15), folder, tables.bucket_of(key))
    tables.append_buckets(spark.range(0), folder, tables.bucket_of(key))
    assert sorted(r["id"] for r in tables.load(spark, folder).collect()) == list(range(15))
    tables.replace_buckets(spark.range(0), folder, tables.bucket_of(key), range(64))
    assert tables.load(spark, folder).count() == 0 and tables.load(spark, folder).columns == ["id"]
    tables.replace_buckets(spark.range(3), folder, tables.bucket_of(key), range(64))
    assert tables.load(spark, folder).count() == 3
    tables.append_buckets(spark.range(0), str(tmp_path / "none"), tables.bucket_of(key))
    assert tables.load(spark, str(tmp_path / "none")).count() == 0


def test_stores_are_compared_by_digests(spark, tmp_path, monkeypatch):
    """No text is read where digests are kept; those of a bucket that was written without them are made of its chunks; equal stores have no unequal bucket."""
    raw, store, target = tmp_path / "raw", str(tmp_path / "store"), str(tmp_path / "target")
    raw.mkdir()
    (raw / "1.jsonl").write_text("\n".join(json.dumps(record(k)) for k in range(15)))
    jobs.build(spark, str(raw), store)
    assert {tuple(r) for r in jobs.resync(spark, store, target).collect()} == {(k, "replace") for k in range(15)}
    jobs.publish(spark, store, target)
    key = lambda r: (r["document_id"], r["n"], r["hash"])
    whole = lambda s: sorted(map(key, maintenance.content_hash(tables.load(spark, f"{s}/chunks")).collect()))
    for s in (store, target):
        held = jobs.digests(spark, s)
        assert "text" not in held._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1] and sorted(map(key, held.collect())) == whole(s)
    assert maintenance.unequal_buckets(jobs.digests(spark, store), jobs.digests(spark, target), tables.bucket_of(F.col("document_id"))) == []
    assert jobs.resync(spark, store, target).count() == 0
    # Chunks are written, their digests are not: the build breaks off between.
    (raw / "2.jsonl").write_text(json.dumps(record(4, "b", "Neu.")) + "\n" + json.dumps(record(70)))
    put = tables.replace_buckets

    def failing(df, folder, *a):
        if folder.endswith("/digests"):
            raise OSError("aus")
        return put(df, folder, *a)

    monkeypatch.setattr(tables, "replace_buckets", failing)
    with pytest.raises(OSError, match="aus"):
        jobs.build(spark, str(raw), store)
    monkeypatch.setattr(tables, "replace_buckets", put)
    assert sorted(map(key, jobs.digests(spark, store).collect())) == whole(store)
    assert {tuple(r) for r in jobs.resync(spark, store, target).collect()} == {(4, "replace"), (70, "replace")}
    jobs.build(spark, str(raw), store)
    assert {tuple(r) for r in jobs.resync(spark, target, store).collect()} == {(4, "replace"), (70, "delete")}


def test_feedback(spark, tmp_path):
    given = spark.createDataFrame([(True, "Frage", "x", "Antwort", ["21/1", "21/2"], "gut"), (None, "F", "x", "A", None, None), (False, " ", "x", "A", None, None), (False, "F" * 3000, None, "A", None, "")], "hilfreich boolean, frage string, suchbegriffe string, antwort string, belegte_dokumente array<string>, anmerkung string")
    assert jobs.feedback(spark, str(tmp_path), given) == 2 and jobs.feedback(spark, str(tmp_path), given.limit(1)) == 1
    rows = tables.load(spark, f"{tmp_path}/feedback").collect()
    assert sorted((len(r["frage"]), r["anzahl_stellen"], r["anmerkung"]) for r in rows) == [(5, 2, "gut"), (5, 2, "gut"), (2000, 0, None)] and all(r["zeitpunkt"] for r in rows)


def test_embedding_commits_by_parts(spark, tmp_path):
    raw, store = tmp_path / "raw", str(tmp_path / "store")
    raw.mkdir()
    (raw / "1.jsonl").write_text("\n".join(json.dumps(record(k)) for k in range(12)))
    jobs.build(spark, str(raw), store)

    class Failing(HashEmbedder):
        def embed(self, texts, task="document"):
            raise ValueError("aus")

    chunks = tables.load(spark, f"{store}/chunks").count()
    assert jobs.embed(spark, store, HashEmbedder(8), 5, commit=3) == 2
    first = tables.current(spark, f"{store}/vectors")
    with pytest.raises(Exception, match="aus"):
        jobs.embed(spark, store, Failing(8))
    assert tables.current(spark, f"{store}/vectors") == first and jobs.stats(spark, store)["vektoren"] == 5
    jobs.embed(spark, store, HashEmbedder(8), commit=4)
    assert tables.current(spark, f"{store}/vectors")[: len(first)] == first and jobs.stats(spark, store)["vektoren"] == chunks


STEMS = {"mietpreisen": "mietpreis", "häuser": "haus", "kategorische": "kategor", "katers": "kat", "aufeinander": "aufeinand", "aufeinanderfolge": "aufeinanderfolg", "käufer": "kauf", "verteidigung": "verteid", "kleinigkeit": "kleinig", "freundlichkeit": "freundlich", "erkenntnisse": "erkenntnis", "großen": "gross", "bauen": "bau", "e": "e", "": ""}


@pytest.mark.parametrize("word", STEMS)
def test_stem(word):
    assert german.stem(word) == STEMS[word]


def test_stemmed_postings(spark):
    c = spark.createDataFrame([(1, "Die Mietpreise und der Mietpreis", ""), (2, "mietpreisen", "und")], "chunk_id long, text string, redner string")
    rows = {(r["term"], r["chunk_id"]): r["hits"] for r in german.stemmed_postings(lexical.postings(c)).collect()}
    assert rows == {("mietpreis", 1): 2, ("mietpreis", 2): 1}


def test_chunk_ids(spark):
    rows = spark.createDataFrame([(0, 0), (7, 3), (9_007_199_255, CHUNK_PLACES - 1), (123_456_789_012, 5)], "d long, p int")
    got = rows.select("d", "p", segment.chunk_id(F.col("d"), F.col("p")).alias("c")).withColumn("back", segment.document_of(F.col("c"))).collect()
    # Whole numbers: a double would lose the last places of large ids.
    assert all(r["c"] == r["d"] * CHUNK_PLACES + r["p"] and r["back"] == r["d"] for r in got)
    with pytest.raises(Exception, match="too many chunks"):
        spark.createDataFrame([(1, CHUNK_PLACES)], "d long, p int").select(segment.chunk_id(F.col("d"), F.col("p"))).collect()
