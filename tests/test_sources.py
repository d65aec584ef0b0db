"""Readers, writers, limits and the stream twin."""

import datetime
import json
import os
import random
import shutil
import threading
import time
from functools import partial
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from spindrift import jobs
from spindrift.models import HashEmbedder, ModelError, embed, in_flight, retried
from spindrift.operators import evaluation as E
from spindrift.operators import limits as L
from spindrift.operators import maintenance as M
from spindrift.sources import events, jsonl, rest, tables
from spindrift.streaming import windows


class Pages(BaseHTTPRequestHandler):
    """Five records by pages of two; the first request of all fails once."""

    failed = False
    seen: list[dict] = []

    def do_GET(self):
        asked = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        Pages.seen.append(asked)
        if not Pages.failed:
            Pages.failed = True
            self.send_response(503)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        at = int(asked.get("cursor", 0))
        page = [{"id": str(k), "titel": f"T{k}"} for k in range(at, min(at + 2, 5))]
        body = json.dumps({"documents": page, "cursor": str(min(at + 2, 5)), "numFound": 5}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_rest(spark):
    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(rest.RestSource)
    df = spark.read.format("paged_rest").options(url=f"http://127.0.0.1:{server.server_port}", paths="x", terms="21", pause="0").load()
    rows = df.select(jsonl.parsed(F.col("record")).alias("r")).select("r.*").orderBy("id").collect()
    server.shutdown()
    assert [r["titel"] for r in rows] == [f"T{k}" for k in range(5)]
    assert all(a.get("f.wahlperiode") == "21" and "f.zuordnung" not in a for a in Pages.seen)


class Updated(BaseHTTPRequestHandler):
    """Records by their last update, filtered as asked (both ends inclusive), two a page."""

    records: dict[str, tuple[str, str]] = {}
    asked: list[tuple] = []

    def do_GET(self):
        asked = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        since, until = asked.get("f.aktualisiert.start", ""), asked.get("f.aktualisiert.end", "9")
        if "cursor" not in asked:
            Updated.asked.append((since, until))
        rows = sorted((u, k, t) for k, (u, t) in Updated.records.items() if since <= u <= until)
        at = int(asked.get("cursor", 0))
        page = [{"id": k, "aktualisiert": u, "text": t, "dokumentart": "Drucksache"} for u, k, t in rows[at : at + 2]]
        body = json.dumps({"documents": page, "cursor": str(min(at + 2, len(rows))), "numFound": len(rows)}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_a_harvest_follows_the_endpoint(spark, tmp_path, monkeypatch):
    """Runs take what was updated since the one before; one that broke off is harvested again and loses no record."""
    server = HTTPServer(("127.0.0.1", 0), Updated)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, raw, mark = f"http://127.0.0.1:{server.server_port}", str(tmp_path / "raw"), str(tmp_path / "mark")
    held = lambda: {r["id"]: r["text"] for r in M.latest(M.incoming(jsonl.read(spark, raw))).collect()}
    go = lambda until: jobs.follow(spark, url, raw, mark, "drucksache", until=until, pause="0")
    Updated.records = {str(k): (f"2025-01-0{k}", f"alt {k}") for k in range(1, 6)}
    assert go("2025-01-03") == 3 and held() == {1: "alt 1", 2: "alt 2", 3: "alt 3"}
    assert go("2025-01-03") == 0
    Updated.records |= {"2": ("2025-01-06", "neu 2"), "9": ("2025-01-04", "neu 9")}
    write = jsonl.write

    def failing(*a):
        write(*a)
        raise OSError("aus")

    monkeypatch.setattr(jsonl, "write", failing)
    with pytest.raises(Exception, match="aus"):
        go("2025-01-04")
    monkeypatch.setattr(jsonl, "write", write)
    # The record at the end of the former times comes twice; the batch that broke off, again as a whole.
    assert go("2025-01-07") >= 3 and held() == {1: "alt 1", 2: "neu 2", 3: "alt 3", 4: "alt 4", 5: "alt 5", 9: "neu 9"}
    assert go("2025-01-07") == 0
    server.shutdown()
    assert Updated.asked[0] == ("", "2025-01-03") and all(since >= "2025-01-03" for since, _ in Updated.asked[1:])


def test_retries():
    waits = []
    answers = [(429, {"Retry-After": "7"}, ""), (500, {}, ""), (200, {}, "{}")]
    assert rest.get_json("u", lambda _: answers.pop(0), sleep=waits.append) == {} and waits == [7.0, 2.0]
    with pytest.raises(RuntimeError, match="404"):
        rest.get_json("u", lambda _: (404, {}, ""), sleep=waits.append)
    pages = {"a": {"documents": [{"id": 1}], "cursor": None, "numFound": 9}}
    assert list(rest.paginate("b", "p", {"x__y": None}, lambda _: pages["a"], sleep=waits.append)) == [{"id": 1}]
    tries = []

    def fails():
        tries.append(1)
        raise OSError

    with pytest.raises(OSError):
        retried(fails, sleep=lambda _: None)
    assert len(tries) == 5


def test_model_errors():
    """What may pass is tried again, as long as the service asks for; what is final is not."""
    waits, answers = [], [ModelError(429, "zu viele", 9.0), ModelError(503), OSError(), None]

    def call():
        e = answers.pop(0)
        if e is not None:
            raise e
        return [1]

    assert retried(call, sleep=waits.append) == [1] and waits == [9.0, 4.0, 8.0]
    answers = [ModelError(400, "nein")]
    with pytest.raises(ModelError, match="400 nein"):
        retried(call, sleep=waits.append)
    answers = [ModelError(500)] * 5
    with pytest.raises(ModelError, match="500"):
        retried(call, sleep=waits.append)
    assert answers == []


def test_calls_in_flight():
    """Six at once, in order, none begun before its turn; a failure ends all."""
    lock, at_once, most, begun = threading.Lock(), [0], [0], []

    def call(k):
        with lock:
            begun.append(k)
            at_once[0] += 1
            most[0] = max(most[0], at_once[0])
        time.sleep(0.05 if k % 6 else 0.1)
        with lock:
            at_once[0] -= 1
        if k == 40:
            raise OSError("aus")
        return k

    start = time.perf_counter()
    assert list(in_flight((partial(call, k) for k in range(36)), 6)) == list(range(36)) and most[0] == 6
    assert time.perf_counter() - start < 42 * 0.05 / 2
    begun.clear()
    results = in_flight((partial(call, k) for k in range(1000)), 6)
    assert [next(results) for _ in range(3)] == [0, 1, 2] and len(begun) <= 9
    with pytest.raises(OSError, match="aus"):
        list(results)
    assert max(begun) < 60
    assert list(in_flight(iter([]))) == []


def test_a_call_of_fewer_vectors_is_an_error(spark):
    class Short(HashEmbedder):
        def embed(self, texts, task="document"):
            return super().embed(texts)[1:]

    chunks = spark.createDataFrame([(k, f"t{k}") for k in range(300)], "chunk_id long, text string")
    with pytest.raises(Exception, match="63 vectors for 64 texts"):
        embed(chunks.coalesce(1), Short(4)).collect()
    own = HashEmbedder(4)
    got = {r["chunk_id"]: [round(x, 5) for x in r["embedding"]] for r in embed(chunks, own, flight=3).collect()}
    assert got == {k: [round(x, 5) for x in own.embed([f"t{k}"])[0]] for k in range(300)}


def test_decisions_do_not_depend_on_batches(spark, tmp_path):
    """Events in one file, and in one file for each hour, taken one by one: the same decisions as of all at once; state goes, and what is far too late has no decision."""
    rng = random.Random(2)
    start = datetime.datetime(2025, 3, 1, tzinfo=datetime.UTC)
    rows = sorted(((start + datetime.timedelta(seconds=rng.randrange(6 * 3600)), f"k{rng.randrange(4)}") for _ in range(400)), key=lambda r: r[0])
    rows = [(k, t, u) for k, (t, u) in enumerate(rows)]
    schema = "event_id long, ts timestamp, kennung string"
    want = {r["event_id"]: (r["anzahl"], r["erlaubt"], r["verbleibend"]) for r in L.decisions(spark.createDataFrame(rows, schema), 3, "10 minutes").collect()}
    for n, name in ((1, "one"), (6, "six")):
        folder = tmp_path / name
        folder.mkdir()
        for k in range(n):
            part = [r for r in rows if n == 1 or int((r[1] - start).total_seconds() // 3600) == k]
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}-{k}"))
            [own] = (tmp_path / f"{name}-{k}").glob("part-*.parquet")
            shutil.copy(own, folder / f"{k}.parquet")
            os.utime(folder / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        windows.write_once(windows.decisions(stream, 3, "10 minutes"), str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-ck")).awaitTermination()
        got = {r["event_id"]: (r["anzahl"], r["erlaubt"], r["verbleibend"]) for r in spark.read.parquet(str(tmp_path / f"{name}-out")).collect()}
        assert got == want
    spark.createDataFrame([(9000, start, "k0"), (9001, start + datetime.timedelta(hours=9), "k0")], schema).coalesce(1).write.parquet(str(tmp_path / "more"))
    [own] = (tmp_path / "more").glob("part-*.parquet")
    shutil.copy(own, tmp_path / "six" / "9.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "six"))
    windows.write_once(windows.decisions(stream, 0, "10 minutes"), str(tmp_path / "six-out"), str(tmp_path / "six-ck")).awaitTermination()
    late = {r["event_id"]: (r["anzahl"], r["erlaubt"], r["verbleibend"]) for r in spark.read.parquet(str(tmp_path / "six-out")).where("event_id >= 9000").collect()}
    assert late == {9001: (1, True, None)}


def test_jsonl(spark, tmp_path):
    lines = [{"id": "1", "aktualisiert": "a", "titel": " x\r\ny "}, {"id": "1", "aktualisiert": "b", "text": "neu"}, {"id": "2", "fundstelle": {"datum": "2025-01-01", "dokumentart": "D"}}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nkaputt\n")
    new = M.latest(M.incoming(jsonl.read(spark, str(tmp_path / "r.jsonl"))))
    rows = {r["id"]: r for r in new.collect()}
    assert set(rows) == {1, 2} and rows[1]["aktualisiert"] == "b" and rows[1]["status"] == "fetched"
    assert rows[2]["dokumentart"] == "D" and rows[2]["datum"] == "2025-01-01" and rows[2]["status"] == "pending"


def test_table_versions(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert tables.load(spark, folder) is None
    tables.replace(spark.range(3), folder)
    tables.replace(tables.load(spark, folder).where("id > 0"), folder)
    assert sorted(r["id"] for r in tables.load(spark, folder).collect()) == [1, 2]


def test_tables_grow_by_commits(spark, tmp_path):
    folder = str(tmp_path / "t")
    tables.append(spark.range(3), folder)
    tables.append(spark.range(3, 5), folder)
    assert sorted(r["id"] for r in tables.load(spark, folder).collect()) == list(range(5)) and len(tables.current(spark, folder)) == 2
    before = tables.load(spark, folder)
    tables.replace(before.where("id > 3"), folder)
    # A reader of the table as it was still finds its files, until the grace is over.
    assert before.count() == 5 and tables.load(spark, folder).count() == 1
    tables.replace(spark.range(1), folder)
    assert not tables.vacuum(spark, folder) and len(tables.vacuum(spark, folder, 0)) == 2
    assert tables.load(spark, folder).count() == 1
    # A version that no pointer names, as a crash leaves it, is never read.
    spark.range(9).write.parquet(f"{folder}/v-lost")
    (tmp_path / "t" / "_halfway").write_text("v-lost")
    assert tables.load(spark, folder).count() == 1


def test_harvests(spark, tmp_path):
    """Of a full and an incremental harvest the new version always wins; a harvest of one kind leaves the other."""

    def records(k, version):
        return spark.createDataFrame([(str(k), version, "t")], "id string, aktualisiert string, text string")

    for trial in range(20):
        raw = str(tmp_path / str(trial))
        jsonl.write(records(1, "a"), raw, "drucksache", 21)
        jsonl.write(records(2, "a"), raw, "plenarprotokoll", 21)
        jsonl.write(records(1, "b"), raw, "drucksache", 21, since="x")
        assert {r["id"]: r["aktualisiert"] for r in M.latest(M.incoming(jsonl.read(spark, raw))).collect()} == {1: "b", 2: "a"}
    jsonl.write(records(1, "c"), raw, "drucksache", 21)
    assert {r["id"]: r["aktualisiert"] for r in M.latest(M.incoming(jsonl.read(spark, raw))).collect()} == {1: "c", 2: "a"}
    assert jsonl.read(spark, raw).count() == 2
    jsonl.write(records(1, "d"), raw, "drucksache", 20)
    assert {r["id"]: r["aktualisiert"] for r in M.latest(M.incoming(jsonl.read(spark, raw))).collect()} == {1: "d", 2: "a"}


def test_events():
    sent = "".join(events.lines([{"a": 1}, {"b": "ü"}]))
    assert list(events.parse([sent[:9], sent[9:20], sent[20:], "data: kaputt\n\n", 'data: {"c"'])) == [{"a": 1}, {"b": "ü"}]


def test_embed(spark):
    c = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "chunk_id long, text string")
    rows = {r["chunk_id"]: r["embedding"] for r in embed(c, HashEmbedder(16)).collect()}
    assert rows[1] == rows[2] and len(rows[3]) == 16 and not any(rows[3])
    done = spark.createDataFrame([(1,)], "chunk_id long")
    assert [r["chunk_id"] for r in M.unembedded(c, done).orderBy("chunk_id").collect()] == [2, 3]


def test_limits(spark):
    e = spark.createDataFrame([(k, "a", f"2025-01-01 00:00:{k:02d}") for k in range(12)] + [(99, "a", "2025-01-01 00:01:00")], "event_id long, kennung string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    d = {r["event_id"]: r for r in L.decisions(e, 10).collect()}
    assert d[9]["erlaubt"] and d[9]["verbleibend"] == 0 and not d[10]["erlaubt"] and d[10]["verbleibend"] == 0 and d[99]["anzahl"] == 1
    assert all(r["erlaubt"] and r["verbleibend"] is None for r in L.decisions(e, 0).collect())


def test_limits_by_purpose(spark):
    rows = [(k, p, "1.2.3.4", f"2025-01-01 00:00:{k:02d}") for p in ("ask", "login", "other") for k in range(12)]
    d = L.decided(spark.createDataFrame(rows, "event_id long, purpose string, address string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))).collect()
    assert {p: sum(r["erlaubt"] for r in d if r["purpose"] == p) for p in ("ask", "login", "other")} == {"ask": 10, "login": 5, "other": 12}
    assert {r["verbleibend"] for r in d if r["purpose"] == "other"} == {None}


def test_stream_equals_batch(spark, small, tmp_path):
    source = tmp_path / "in"
    e = spark.read.parquet(f"{small}/events.parquet")
    late = e.orderBy(F.col("ts").desc()).limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 30 DAYS"))
    e.unionByName(late).coalesce(1).write.parquet(str(source))
    asked = windows.read_events(spark, str(source)).select(L.key("ask", F.col("event_type")).alias("kennung"), "ts")
    windows.write_once(windows.counts(asked, "1 hour"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    rows = lambda df: sorted(map(tuple, df.select("kennung", "fenster", "anzahl").collect()))
    batch = e.select(L.key("ask", F.col("event_type")).alias("kennung"), F.col("ts").cast("timestamp").alias("ts"))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(L.counts(batch, "1 hour"))


def test_questions(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"hinweis": "", "fragen": [{"frage": "a", "ziele": ["21/1", "21/2"], "art": "gesetz"}, {"frage": "b", "ziele": [], "art": "negativ"}]}))
    q = E.read_questions(spark, str(tmp_path / "q.json"))
    assert q.count() == 2
    ranked = spark.createDataFrame([(0, "21/9", 1), (0, "21/2", 2)], "frage_id int, dokument string, rank int")
    row = E.metrics(E.judge(ranked, E.targets(q), 5)).first()
    assert tuple(row) == (1, 1, 1.0, 2.0) and "1/1" in E.report(row, [])
