"""Batch jobs of the engine: each reads and replaces tables of one store folder."""

from __future__ import annotations

import hashlib
import statistics
import time
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import models
from .operators import ann, evaluation, fusion, limits, maintenance, segment
from .plans import search as plans
from .profiles import CHUNK_PLACES, PROFILES, SQLITE, Profile
from .shipping import shared_folder, shipped
from .sources import index as stored_index
from .sources import jsonl, rest, tables

#: Chunks that are embedded between two commits.
COMMIT = 50_000
KINDS = {"drucksache": "drucksache-text", "plenarprotokoll": "plenarprotokoll-text"}


def harvest(spark: SparkSession, url: str, raw: str, kind: str = "alle", term: int = 21, since: str | None = None, token: str | None = None, assignment: str | None = None) -> int:
    """Reads the endpoints of a kind into JSON lines, a harvest for each; with ``since`` only what was updated from then on is added.

    A full harvest replaces the former ones of the same kind and term and leaves those of others. Returns the number of records.
    """
    shipped(spark).dataSource.register(rest.RestSource)
    count = 0
    for own in list(KINDS) if kind == "alle" else [kind]:
        options = {"url": url, "paths": KINDS[own], "terms": str(term)}
        options |= {k: v for k, v in (("since", since), ("token", token), ("assignment", assignment)) if v}
        records = spark.read.format("paged_rest").options(**options).load()
        folder = jsonl.write(records.select(jsonl.parsed(F.col("record")).alias("r")).select("r.*"), raw, own, term, since)
        count += spark.read.schema(jsonl.RAW).json(folder).count()
    return count


def follow(spark: SparkSession, url: str, raw: str, checkpoint: str, kind: str = "alle", term: int = 21, token: str | None = None, assignment: str | None = None, **options) -> int:
    """Harvests what was updated since the last run of the same ``checkpoint`` (at first all), a stream for each kind that ends when it has caught up; returns how many records came.

    A batch becomes a harvest that is added to the others. One that broke off is harvested again: its records may then be in two harvests, of which a build
    takes the last version of each.
    """
    shipped(spark).dataSource.register(rest.RestSource)
    # One end for all runs below: a run after one that broke off takes its batch first, and what came since in another.
    options = {"until": rest.until()} | options
    came, batches = [0], [0]
    for own in list(KINDS) if kind == "alle" else [kind]:
        known = {"url": url, "paths": KINDS[own], "terms": str(term)} | {k: v for k, v in (("token", token), ("assignment", assignment)) if v} | options

        def take(batch: DataFrame, number: int, own: str = own) -> None:
            folder = jsonl.write(batch.select(jsonl.parsed(F.col("record")).alias("r")).select("r.*"), raw, own, term, f"batch {number}")
            came[0] += batch.sparkSession.read.schema(jsonl.RAW).json(folder).count()
            batches[0] += 1

        before = -1
        while batches[0] > before:
            before = batches[0]
            stream = spark.readStream.format("paged_rest").options(**known).load()
            stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{checkpoint.rstrip('/')}/{own}-{term}").trigger(availableNow=True).start().awaitTermination()
    return came[0]


def _documents(spark: SparkSession, store: str) -> DataFrame:
    found = tables.load(spark, f"{store}/documents")
    if found is not None:
        return found
    schema = "id long, dokumentart string, dokumentnummer string, drucksachetyp string, wahlperiode int, herausgeber string, titel string, datum string, pdf_url string, aktualisiert string, text_len int, status string, chunked_at timestamp"
    return spark.createDataFrame([], schema)


def build(spark: SparkSession, raw: str, store: str, force: bool = False, kind: str = "alle") -> int:
    """Upserts raw records (of a kind) and cuts changed documents anew (all with ``force``); chunks are replaced in the buckets of these, the narrow documents whole.

    Vectors of what is cut anew go first, so that none is ever beside another text, and the index follows at last: it gets a segment of the changed
    documents. Where nothing changed nothing is written. Returns how many documents were cut.
    """
    new = maintenance.latest(maintenance.incoming(jsonl.read(spark, raw)))
    if kind != "alle":
        new = new.where(F.lower("dokumentart") == kind)
    shared_folder(spark)
    # Without texts: what the three tables below need of the upsert is planned and run once.
    after = maintenance.upsert(_documents(spark, store), new.drop("text")).checkpoint()
    touched = after.agg(F.count_if("changed").alias("changed"), F.count_if(F.expr("text_len > 0" if force else "text_len > 0 and changed")).alias("cut")).first()
    if not touched["changed"] and not touched["cut"] and tables.current(spark, f"{store}/documents"):
        return 0
    held = index_of(spark, store)
    done = after.where("text_len > 0" if force else "text_len > 0 and changed").select(F.col("id").alias("cut_id"))
    cut = new.select("id", "dokumentart", "text").join(done, F.col("id") == F.col("cut_id"), "left_semi")
    pieces = segment.segment(cut.withColumnRenamed("id", "document_id"))
    pieces = pieces.withColumn("chunk_id", segment.chunk_id(F.col("document_id"), F.col("position")))
    pieces = pieces.select("chunk_id", "document_id", F.col("position").cast("int").alias("position"), "text", "redner", "rolle", "fraktion")
    ids = done.select(F.col("cut_id").alias("document_id"))
    _forget(spark, store, ids)
    if touched["cut"] or not tables.current(spark, f"{store}/chunks"):
        _exchange(spark, store, pieces, ids)
    joined = after.join(done, after.id == done.cut_id, "left")
    joined = joined.withColumn("status", F.when(F.col("cut_id").isNotNull(), "chunked").otherwise(F.col("status"))).withColumn("chunked_at", F.when(F.col("cut_id").isNotNull(), F.current_timestamp()).otherwise(F.col("chunked_at")))
    tables.replace(joined.drop("changed", "cut_id"), f"{store}/documents")
    if held is not None:
        _follow(spark, store, after.where("changed" if not force else "changed or text_len > 0").select(F.col("id").alias("document_id")))
    return touched["cut"]


def _of_document() -> Column:
    return tables.bucket_of(F.col("document_id"))


def _of_chunk() -> Column:
    return tables.bucket_of(segment.document_of(F.col("chunk_id")))


def _forget(spark: SparkSession, store: str, ids: DataFrame) -> None:
    """Removes the vectors of the documents ``ids(document_id)``; buckets that hold none of these are neither read nor written."""
    buckets = [r[0] for r in ids.select(_of_document()).distinct().collect()]
    held = tables.load(spark, f"{store}/vectors", buckets)
    if held is not None and buckets:
        left = held.join(ids, segment.document_of(held.chunk_id) == ids.document_id, "left_anti")
        tables.replace_buckets(left, f"{store}/vectors", _of_chunk(), buckets)


def _exchange(spark: SparkSession, store: str, pieces: DataFrame, ids: DataFrame) -> None:
    """Puts ``pieces`` in the place of all chunks of the documents ``ids(document_id)``, in the buckets of these alone."""
    buckets = [r[0] for r in ids.select(_of_document()).distinct().collect()]
    held = tables.load(spark, f"{store}/chunks", buckets)
    if held is None:
        held = spark.createDataFrame([], tables.CHUNKS)
    tables.replace_buckets(maintenance.replace_chunks(held, pieces, ids), f"{store}/chunks", _of_document(), buckets)
    now = maintenance.content_hash(tables.load(spark, f"{store}/chunks", buckets))
    tables.replace_buckets(now.withColumn("state", _chunk_state(spark, store)), f"{store}/digests", _of_document(), buckets)


def _chunk_state(spark: SparkSession, store: str) -> Column:
    """What stands for the files that a document's bucket of chunks has now; null where chunks are not in buckets."""
    files: dict[int, list[str]] = {}
    for v in tables.current(spark, f"{store}/chunks"):
        if "/bucket=" in v:
            files.setdefault(int(v.split("=")[1]), []).append(v)
    known = F.create_map(*[F.lit(x) for k, v in files.items() for x in (k, _digest(v))]) if files else F.create_map().cast("map<int,string>")
    return F.try_element_at(known, _of_document())


def digests(spark: SparkSession, store: str, buckets: list[int] | None = None) -> DataFrame:
    """(document_id, n, hash) of the store's documents (in some buckets): as they were kept when chunks were written, or of the chunks themselves where these have been written since."""
    schema, now = "document_id long, n long, hash decimal(38,0)", _chunk_state(spark, store)
    held, chunks = tables.load(spark, f"{store}/digests", buckets), tables.load(spark, f"{store}/chunks", buckets)
    if chunks is None:
        return spark.createDataFrame([], schema)
    if held is None or not tables.by_buckets(spark, f"{store}/chunks"):
        return maintenance.content_hash(chunks)
    # A row for each bucket that was written otherwise.
    stale = [r[0] for r in held.where(~F.col("state").eqNullSafe(now)).select(_of_document()).distinct().collect()]
    known = {r[0] for r in held.select(_of_document()).distinct().collect()}
    stale += [k for v in tables.current(spark, f"{store}/chunks") if "/bucket=" in v and (k := int(v.split("=")[1])) not in known and (buckets is None or k in buckets)]
    sound = held.select("document_id", "n", "hash")
    if not stale:
        return sound
    return sound.where(~_of_document().isin(stale)).unionByName(maintenance.content_hash(tables.load(spark, f"{store}/chunks", stale)))


def embed(spark: SparkSession, store: str, embedder: models.Embedder, limit: int | None = None, commit: int = COMMIT) -> int:
    """Adds vectors of open chunks in order of priority, about ``commit`` at a time; what is there is not computed or written again.

    Each part is a commit of its own, so a run that fails keeps what it had and the next one goes on there. Returns the number of parts.
    """
    chunks, parts = tables.load(spark, f"{store}/chunks"), 0
    stored = tables.load(spark, f"{store}/vectors")
    if stored is None:
        stored = spark.createDataFrame([], "chunk_id long, embedding array<float>")
    shared_folder(spark)
    queue = maintenance.embed_queue(chunks, tables.load(spark, f"{store}/documents"), stored, limit).checkpoint()
    for row in queue.groupBy("prioritaet").count().orderBy("prioritaet").collect():
        own, rounds = queue.where(F.col("prioritaet") == row["prioritaet"]), -(-row["count"] // commit)
        for k in range(rounds):
            part = own.where(F.pmod(F.xxhash64("chunk_id"), F.lit(rounds)) == k).select("chunk_id")
            tables.append_buckets(models.embed(chunks.join(part, "chunk_id", "left_semi"), embedder), f"{store}/vectors", _of_chunk())
            parts += 1
    if parts and index_of(spark, store) is not None and ann.read(spark, f"{store}/index/cells") is not None:
        _follow_vectors(spark, store)
    return parts


def serving(spark: SparkSession, store: str) -> DataFrame:
    """Chunks with the columns of their document."""
    d = tables.load(spark, f"{store}/documents").select(F.col("id").alias("document_id"), "dokumentnummer", "dokumentart", "drucksachetyp", "titel", F.expr("try_cast(datum as date)").alias("datum"), "pdf_url")
    return tables.load(spark, f"{store}/chunks").join(d, "document_id")


def vectors(spark: SparkSession, store: str) -> DataFrame | None:
    found = tables.load(spark, f"{store}/vectors")
    return None if found is None else found.join(serving(spark, store).select("chunk_id", "dokumentart", "datum"), "chunk_id")


def search(spark: SparkSession, store: str, question: str, embedder: models.Embedder | None = None, limit: int = 8, profile: Profile = SQLITE, **filters) -> DataFrame:
    """The best chunks of a question with their texts: chunk_id, score, found_by, rank and the columns of ``serving``; by the store's index if it has one."""
    own, chunks = index_of(spark, store), serving(spark, store)
    vector = embedder.embed([question], models.QUERY)[0] if embedder is not None else None
    hits = plans.hybrid(chunks, vectors(spark, store), plans.asked(spark, question, profile), vector, profile, plans.filters(**filters), limit, own, cells_of(spark, store), plans.zones(**filters))
    if own is not None:
        hits = fusion.pinned(hits)
        chunks = own.of_documents(r["chunk_id"] // CHUNK_PLACES for r in hits.collect())
    return chunks.join(F.broadcast(hits), "chunk_id").orderBy("rank")


def ask(spark: SparkSession, store: str, question: str, generator: models.Generator, embedder: models.Embedder | None, analyse_template: str, answer_template: str, **options):
    """The events of ``plans.search.ask`` over a store, by its index if it has one."""
    return plans.ask(serving(spark, store), vectors(spark, store), question, generator, embedder, analyse_template, answer_template, index=index_of(spark, store), cells=cells_of(spark, store), **options)


def index(spark: SparkSession, store: str, buckets: int = stored_index.BUCKETS, whole: bool = False) -> None:
    """Brings the store's index up to its tables: cells of its vectors, postings by word and stem, frequencies, and its chunks by document.

    Where there is an index, documents whose chunks or columns differ from what it has are found by their hashes and become a segment of it; ``whole`` writes all anew, as the first time.
    """
    own = None if whole else stored_index.read(spark, f"{store}/index")
    if own is None:
        found = vectors(spark, store)
        stored_index.write(serving(spark, store), f"{store}/index", buckets, _state(spark, store))
        if found is not None:
            own = stored_index.read(spark, f"{store}/index")
            ann.write(found, f"{store}/index/cells", id_="chunk_id", state=_vectors_state(spark, store, own), segment=own.segments[-1])
        return
    if own.state != _state(spark, store):
        now, there = (c.select("document_id", "position", F.to_json(F.struct(*sorted(c.columns))).alias("text")) for c in (serving(spark, store), own.chunks))
        shared_folder(spark)
        _follow(spark, store, maintenance.resync(now, there).select("document_id").checkpoint())
    else:
        _follow_vectors(spark, store)


def _state(spark: SparkSession, store: str) -> str:
    """What stands for the versions that chunks and documents have now."""
    return _digest([tables.current(spark, f"{store}/{t}") for t in ("chunks", "documents")])


def _digest(versions: list) -> str:
    return hashlib.sha256(repr(versions).encode()).hexdigest()


def _vectors_state(spark: SparkSession, store: str, own: stored_index.Index) -> str:
    """What cells are written from: the index's first segment, by whose later ones their vectors go out of count, and the versions of the tables."""
    return f"{own.segments[0]} {_state(spark, store)} {_digest(tables.current(spark, f'{store}/vectors'))}"


def _follow(spark: SparkSession, store: str, changed: DataFrame) -> None:
    """The index after the documents ``changed(document_id)`` and the vectors that came since."""
    folder = f"{store}/index"
    stored_index.update(serving(spark, store), changed, folder, _state(spark, store))
    if len(stored_index.read(spark, folder).segments) > stored_index.SEGMENTS:
        stored_index.compact(spark, folder)
    _follow_vectors(spark, store)


def _follow_vectors(spark: SparkSession, store: str) -> None:
    """Cells get the vectors that they lack; those of documents that the index has in a later segment no longer count."""
    folder, found = f"{store}/index/cells", vectors(spark, store)
    cells, own = ann.read(spark, folder), stored_index.read(spark, f"{store}/index")
    if found is None:
        return
    state = _vectors_state(spark, store, own)
    if cells is None or cells.state.split(" ")[0] != str(own.segments[0]):
        ann.write(found, folder, id_="chunk_id", state=state, segment=own.segments[-1])
    elif cells.state != state:
        ann.append(found.join(own.alive(cells.vectors).select("chunk_id"), "chunk_id", "left_anti"), folder, id_="chunk_id", state=state, segment=own.segments[-1])


def index_of(spark: SparkSession, store: str) -> stored_index.Index | None:
    """The store's index, unless its tables have other versions than those that it was written from."""
    own = stored_index.read(spark, f"{store}/index")
    return own if own is not None and own.state == _state(spark, store) else None


def cells_of(spark: SparkSession, store: str) -> ann.Cells | None:
    """The cells of the store's vectors, unless its tables have other versions than those that they were written from."""
    own, cells = index_of(spark, store), ann.read(spark, f"{store}/index/cells")
    if own is None or cells is None or cells.state != _vectors_state(spark, store, own):
        return None
    return replace(cells, vectors=own.alive(cells.vectors))


def publish(spark: SparkSession, store: str, target: str, commit: int = COMMIT) -> int:
    """Brings a serving store up to this one: documents whole, chunks by document, then the vectors that it lacks, about ``commit`` at a time; its index follows if it has one.

    Vectors of chunks that differ go first, so that none is ever beside another text. Each part of the vectors is a commit of its own, so a run that broke off
    goes on with those that are still lacking and writes none twice. Returns the number of parts.
    """
    shared_folder(spark)
    chunks = tables.load(spark, f"{store}/chunks")
    actions = resync(spark, store, target).checkpoint()
    own = tables.load(spark, f"{store}/vectors")
    if not actions.isEmpty() or not tables.current(spark, f"{target}/chunks"):
        _forget(spark, target, actions.select("document_id"))
        _exchange(spark, target, chunks, actions.select("document_id"))
    tables.replace(tables.load(spark, f"{store}/documents"), f"{target}/documents")
    parts = 0
    if own is not None:
        held = tables.load(spark, f"{target}/vectors")
        lacking = (own if held is None else maintenance.unembedded(own, held)).checkpoint()
        rounds = -(-lacking.count() // commit)
        for k in range(rounds):
            tables.append_buckets(lacking.where(F.pmod(F.xxhash64("chunk_id"), F.lit(rounds)) == k), f"{target}/vectors", _of_chunk())
            parts += 1
    if stored_index.read(spark, f"{target}/index") is not None:
        index(spark, target)
    return parts


def feedback(spark: SparkSession, store: str, given: DataFrame) -> int:
    """Adds the valid rows of ``given`` (columns of ``tables.FEEDBACK``, but for zeitpunkt and anzahl_stellen) to the store's feedback; returns their number."""
    rows = limits.feedback(given).withColumn("zeitpunkt", F.current_timestamp())
    rows = rows.withColumn("anzahl_stellen", F.size("belegte_dokumente"))
    rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(tables.FEEDBACK).fields])
    version = tables.append(rows, f"{store}/feedback")
    return spark.read.schema(tables.FEEDBACK).parquet(f"{store}/feedback/{version}").count()


def resync(spark: SparkSession, store: str, target: str) -> DataFrame:
    """What ``publish`` would change: digests of buckets are compared first, then those of the documents in unequal ones. Texts are not read."""
    buckets = maintenance.unequal_buckets(digests(spark, store), digests(spark, target), _of_document())
    return maintenance.differences(digests(spark, store, buckets), digests(spark, target, buckets))


def prepare(spark: SparkSession, store: str, asked: DataFrame, embedder: models.Embedder | None, generator: models.Generator | None = None, analyse_template: str = "{frage}", new: bool = False) -> DataFrame:
    """(frage, suchbegriffe, dokumentart, vektor) of each question of an evaluation set, made once and kept in the store.

    So two runs differ in their ranking alone. ``new`` makes all of them again. A set is a file that one reads, so its
    questions go through the models in the driver.
    """
    folder = f"{store}/eval_cache"
    known = None if new else tables.load(spark, folder)
    if known is None:
        known = spark.createDataFrame([], "frage string, suchbegriffe string, dokumentart string, vektor array<double>")
    rows = []
    for r in evaluation.uncached(asked, known).select("frage").distinct().collect():
        found = plans.analyse(generator, analyse_template, r["frage"]) if generator is not None else {"suchbegriffe": r["frage"], "dokumentart": None}
        rows.append((r["frage"], found["suchbegriffe"], found["dokumentart"], [float(x) for x in embedder.embed([r["frage"]], models.QUERY)[0]] if embedder is not None else None))
    if rows:
        made = spark.createDataFrame(rows, known.schema)
        (tables.replace if new else tables.append)(made.coalesce(1), folder)
        known = tables.load(spark, folder)
    return known.join(asked.select("frage").distinct(), "frage", "left_semi").dropDuplicates(["frage"])


def evaluate(
    spark: SparkSession,
    store: str,
    questions: str,
    embedder: models.Embedder | None = None,
    top_k: int = 20,
    vector_weight: float = 1.5,
    profile: str = "postgres",
    generator: models.Generator | None = None,
    rerank_template: str | None = None,
    new: bool = False,
) -> str:
    """Report of hit rate, median rank and milliseconds over a set of questions, from what ``prepare`` keeps.

    All questions are one plan: their terms meet the postings once, their vectors go in blocks. With ``rerank_template`` a model
    picks from each question's candidates, a call each.
    """
    asked = evaluation.read_questions(spark, questions)
    positive = asked.where("size(ziele) > 0")
    if positive.isEmpty():
        return "Keine Fragen."
    own = replace(PROFILES[profile], top_k=top_k, vector_weight=vector_weight)
    cache = prepare(spark, store, positive, embedder, generator, new=new)
    began = time.perf_counter()
    known = positive.join(cache, "frage").select("frage_id", "frage", "suchbegriffe", "vektor")
    chunks, held = serving(spark, store), index_of(spark, store)
    limit = top_k if rerank_template is None else fusion.RERANK_MOST
    hits = plans.batch(chunks, vectors(spark, store), known, own, limit, held)
    ranked = hits.join(chunks.select("chunk_id", F.col("dokumentnummer").alias("dokument")), "chunk_id").select("frage_id", "chunk_id", "dokument", "rank")
    times = []
    if rerank_template is not None:
        ranked, parts = fusion.pinned(ranked, 1 << 20), []
        for q in known.select("frage_id", "frage").collect():
            at = time.perf_counter()
            one = ranked.where(F.col("frage_id") == q["frage_id"])
            parts += [(q["frage_id"], r["chunk_id"], r["rank"]) for r in plans.reranked(one, chunks, q["frage"], generator, rerank_template, top_k).collect()]
            times.append(time.perf_counter() - at)
        picked = spark.createDataFrame(parts, "frage_id int, chunk_id long, rank int")
        ranked = picked.join(ranked.select("frage_id", "chunk_id", "dokument"), ["frage_id", "chunk_id"])
    # One row for each question and rank, so few.
    ranked = spark.createDataFrame(ranked.select("frage_id", "dokument", "rank").collect(), "frage_id int, dokument string, rank int")
    spent = time.perf_counter() - began
    judged = evaluation.judge(ranked, evaluation.targets(asked), top_k)
    row = evaluation.metrics(judged).first()
    each = statistics.median(times) if times else spent / max(1, row["fragen"])
    return evaluation.report(row, evaluation.failures(judged, ranked).collect(), 1000 * each)


def stats(spark: SparkSession, store: str) -> dict[str, int]:
    chunks, found = tables.load(spark, f"{store}/chunks"), tables.load(spark, f"{store}/vectors")
    if found is None:
        found = spark.createDataFrame([], "chunk_id long, embedding array<float>")
    marked = chunks.join(found.select("chunk_id").withColumn("embedded", F.lit(True)), "chunk_id", "left").withColumn("embedded", F.coalesce("embedded", F.lit(False)))
    return maintenance.stats(tables.load(spark, f"{store}/documents"), marked, found).first().asDict()
