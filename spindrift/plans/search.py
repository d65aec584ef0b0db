"""Hybrid search and the answer to a question. The words of a question and its few hits are fetched; all else is lazy plans."""

from __future__ import annotations

import datetime
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import german
from ..functions.text import fold, index_tokens, match_terms, query_terms, word_tokens
from ..models import QUERY, Embedder, Generator
from ..operators import ann, answers, fusion, lexical, semantic
from ..operators.evaluation import search_terms
from ..profiles import CHUNK_PLACES, SQLITE, Profile
from ..shipping import shared_folder, tidied
from ..sources.index import Index

NO_HITS = {"de": "Dazu wurde nichts gefunden.", "en": "Nothing was found on this.", "ls": "Dazu gibt es nichts."}


def filters(dokumentart: str | None = None, datum_von: str | None = None, datum_bis: str | None = None) -> Column | None:
    """What a search may be held to: a kind and inclusive dates; absent ones do not filter."""
    parts = []
    if dokumentart:
        parts.append(F.col("dokumentart") == dokumentart)
    if datum_von:
        parts.append(F.col("datum") >= F.lit(datum_von).cast("date"))
    if datum_bis:
        parts.append(F.col("datum") <= F.lit(datum_bis).cast("date"))
    keep = None
    for p in parts:
        keep = p if keep is None else keep & p
    return keep


def zones(dokumentart: str | None = None, datum_von: str | None = None, datum_bis: str | None = None) -> Column | None:
    """``filters`` over the least and greatest values of a cell: false only where none of its rows is kept."""
    parts = []
    if dokumentart:
        parts.append((F.col("least_dokumentart") <= dokumentart) & (F.col("most_dokumentart") >= dokumentart))
    if datum_von:
        parts.append(F.col("most_datum") >= F.lit(datum_von).cast("date"))
    if datum_bis:
        parts.append(F.col("least_datum") <= F.lit(datum_bis).cast("date"))
    may = None
    for p in parts:
        may = p if may is None else may & p
    return may


@dataclass(frozen=True)
class Asked:
    """The words of a question (32 at most), as they are and folded."""

    words: list[str]
    terms: list[str]


def asked_of(question: DataFrame, profile: Profile, column: str = "frage") -> Asked:
    """The words of a one-row question by the profile's rules; fetched, since they say which part of an index is read."""
    words = match_terms(F.col(column)) if profile.lexical == "bm25" else query_terms(F.col(column))
    row = question.select(words.alias("w")).select("w", F.transform("w", fold).alias("t")).first()
    return Asked(row["w"], list(dict.fromkeys(t for t in row["t"] if t))) if row else Asked([], [])


def asked(spark: SparkSession, question: str, profile: Profile) -> Asked:
    return asked_of(spark.createDataFrame([(question,)], "frage string"), profile)


def _rare(stems: list[str], frequency: DataFrame, most: float) -> list[str]:
    """Stems that at most so many chunks hold; all of them if none is. A question's are few."""
    known = {r["term"]: r["ndoc"] for r in frequency.select("term", "ndoc").collect()}
    return [s for s in stems if known.get(s, 0) <= most] or stems


def coverage_scores(chunks: DataFrame, words: list[str], profile: Profile, index: Index | None = None) -> DataFrame:
    """(chunk_id, score) by how often a chunk holds a stem of the question: stopwords and too frequent stems do not count."""
    spark = chunks.sparkSession
    stems = german.question_stems(spark, words)
    if index is None:
        own = german.stem_hits(chunks.select("chunk_id", *[word_tokens(F.col(c)) for c in lexical.WEIGHTS]), stems)
        if profile.max_df is not None:
            own = _kept(own)  # texts are cut once: which stems count is known only then
            stems = _rare(stems, own.groupBy("term").agg(F.count("*").alias("ndoc")), profile.max_df * chunks.count())
    else:
        own = index.of_terms(index.stems, stems)
        if profile.max_df is not None:
            stems = _rare(stems, index.of_terms(index.frequency, stems).where("kind = 'stem'"), profile.max_df * index.count)
    return own.where(F.col("term").isin(stems)).groupBy("chunk_id").agg((F.sum("hits") * 0.1).alias("score"))


def lexical_hits(chunks: DataFrame, question: Asked, profile: Profile, keep: Column | None = None, index: Index | None = None) -> DataFrame:
    """(chunk_id, score, rank) of the best chunks by the profile's lexical score; with an index texts are not read."""
    spark = chunks.sparkSession
    if profile.lexical == "bm25" and index is None:
        terms = spark.createDataFrame([(t,) for t in question.terms], "term string")
        return _ranked(lexical.bm25(chunks, terms, keep=keep), profile)
    if profile.lexical == "bm25":
        frequency = index.of_terms(index.frequency, question.terms).where("kind = 'word'")
        scores = lexical.bm25_indexed(index.of_terms(index.postings, question.terms), frequency, index.count, index.mean)
    else:
        scores = coverage_scores(chunks, question.words, profile, index)
    if keep is not None:
        scores = scores.join(chunks.where(keep).select("chunk_id"), "chunk_id", "left_semi")
    return _ranked(scores, profile)


def _ranked(scores: DataFrame, profile: Profile) -> DataFrame:
    return lexical.top(scores, profile.candidates, [F.round("score", 9).desc(), F.col("chunk_id")])


def semantic_hits(vectors: DataFrame, query, profile: Profile, keep: Column | None = None, cells: ann.Cells | None = None, may: Column | None = None) -> DataFrame:
    """(chunk_id, distance, rank) of the nearest chunks by the profile's metric and way to filter; from a few cells, if there are any.

    A filter that goes before the search is exact: cells are read by the bounds of their vectors, those left out that ``may`` tells to hold no row of it.
    """
    if cells is not None and not isinstance(query, DataFrame):
        if keep is not None and profile.vector_filter == "before":
            near = ann.nearest_filtered(cells, query, profile.candidates, keep, profile.metric, may, "chunk_id")
        else:
            near = ann.nearest(cells, query, profile.candidates, profile.metric, keep, profile.vector_filter, "chunk_id")
    else:
        near = semantic.nearest(vectors, query, profile.candidates, profile.metric, keep, profile.vector_filter, "chunk_id")
    return lexical.top(near.select("chunk_id", "distance"), profile.candidates, [F.round("distance", 9), F.col("chunk_id")])


def hybrid(chunks: DataFrame, vectors: DataFrame | None, question: Asked, query, profile: Profile = SQLITE, keep: Column | None = None, limit: int | None = None, index: Index | None = None, cells: ann.Cells | None = None, may: Column | None = None) -> DataFrame:
    """(chunk_id, score, found_by, rank); without vectors or a query vector the lexical list alone. Vectors carry the columns that ``keep`` reads."""
    lists = {"bm25": (lexical_hits(chunks, question, profile, keep, index), 1.0)}
    if vectors is not None and query is not None:
        lists["vektor"] = (semantic_hits(vectors, query, profile, keep, cells, may), profile.vector_weight)
    return fusion.fuse(lists, limit or profile.top_k, profile.rrf_k)


def batch(chunks: DataFrame, vectors: DataFrame | None, questions: DataFrame, profile: Profile, limit: int, index: Index | None = None) -> DataFrame:
    """(frage_id, chunk_id, score, rank) of ``hybrid`` for each of ``questions(frage_id, suchbegriffe, vektor)``, in one plan.

    Search terms are the words between white space, as an evaluation takes them. They are those of a set that one has read, so they are
    fetched, and postings are read once for all of them; vectors are compared in blocks of questions.
    """
    spark = chunks.sparkSession
    rows = questions.select("frage_id", search_terms(F.col("suchbegriffe")).alias("w")).collect()
    if profile.lexical == "bm25":
        own = lexical.postings(chunks, sizes=True) if index is None else index.postings
        terms = _folded(spark, [(r["frage_id"], w) for r in rows for w in r["w"]])
    else:
        own = german.stemmed_postings(lexical.postings(chunks, tokens=word_tokens)) if index is None else index.stems
        terms = [(r["frage_id"], s) for r in rows for s in german.question_stems(spark, [x for w in r["w"] for x in re.findall(r"[^\W_]+", w)])]
    wanted = sorted({t for _, t in terms})
    own = _kept(own.where(F.col("term").isin(wanted))) if index is None else index.of_terms(own, wanted)
    if index is None:
        frequency, sizes = own.groupBy("term").agg(F.count("*").alias("ndoc")), lexical.lengths(chunks).agg(F.count("*").alias("n"), F.avg("tokens").alias("mean")).first()
        count, mean = sizes["n"], sizes["mean"] or 0.0
    else:
        frequency = index.of_terms(index.frequency, wanted).where(F.col("kind") == ("word" if profile.lexical == "bm25" else "stem"))
        count, mean = index.count, index.mean
    if profile.lexical != "bm25" and profile.max_df is not None:
        known = {r["term"]: r["ndoc"] for r in frequency.collect()}
        by = {q: [t for p, t in terms if p == q] for q in {q for q, _ in terms}}
        terms = [(q, t) for q, ts in by.items() for t in ([t for t in ts if known.get(t, 0) <= profile.max_df * count] or ts)]
    asked_terms = spark.createDataFrame(sorted(set(terms)), "frage_id int, term string")
    per = own.join(F.broadcast(asked_terms), "term")
    if profile.lexical == "bm25":
        scores = lexical.bm25_indexed(per, frequency, count, mean, ["frage_id"])
    else:
        scores = per.groupBy("frage_id", "chunk_id").agg((F.sum("hits") * 0.1).alias("score"))
    place = F.row_number().over(Window.partitionBy("frage_id").orderBy(F.round("score", 9).desc(), "chunk_id"))
    lists = [scores.select("frage_id", "chunk_id", place.alias("r")).where(F.col("r") <= profile.candidates).withColumns({"l": F.lit(0), "w": F.lit(1.0)})]
    if vectors is not None:
        asked_vectors = questions.where("vektor is not null").select(F.col("frage_id").alias("query_id"), F.col("vektor").alias("q"))
        near = semantic.nearest_per_query(vectors, asked_vectors, profile.candidates, profile.metric, "chunk_id", places=9)
        lists.append(near.select(F.col("query_id").alias("frage_id"), "chunk_id", F.col("rank").alias("r")).withColumns({"l": F.lit(1), "w": F.lit(float(profile.vector_weight))}))
    both = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
    fused = both.groupBy("frage_id", "chunk_id").agg(F.sum(F.col("w") / (profile.rrf_k + F.col("r"))).alias("score"), *[F.min(F.when(F.col("l") == n, F.col("r"))).alias(f"r{n}") for n in (0, 1)])
    order = Window.partitionBy("frage_id").orderBy(F.round("score", 12).desc(), F.col("r0").asc_nulls_last(), F.col("r1").asc_nulls_last())
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("frage_id", "chunk_id", "score", "rank")


def _kept(rows: DataFrame) -> DataFrame:
    """``rows`` as files beside the checkpoints, where they stay as long: what is dear to make and read more than once."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    with tidied(spark):
        rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def _folded(spark: SparkSession, words: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Folded tokens of the words of questions."""
    rows = spark.createDataFrame(words, "frage_id int, w string").select("frage_id", F.explode(index_tokens(F.col("w"))).alias("t"))
    return [(r["frage_id"], r["t"]) for r in rows.collect()]


def context_chunks(hits: DataFrame, chunks: DataFrame, profile: Profile = SQLITE, index: Index | None = None) -> tuple[DataFrame, DataFrame]:
    """Hits (fetched) with their neighbours as (chunk_id, ord, is_neighbour), and the chunks that these are among: with an index, they alone."""
    hits = fusion.pinned(hits.select("chunk_id", "rank"))
    if index is not None:
        ids = [r["chunk_id"] for r in hits.collect()]
        reach = sorted({k + d for k in ids for d in range(-profile.window, profile.window + 1)})
        # Ids tell the places around a hit, so one read of their few rows has all that a context needs.
        chunks = fusion.pinned(index.of_documents(k // CHUNK_PLACES for k in ids).where(F.col("chunk_id").isin(reach)))
    return fusion.with_neighbours(hits, chunks, profile.window, profile.neighbours), chunks


def label_of_chunk() -> Column:
    return fusion.source_label(*[F.col(c) for c in ("dokumentart", "dokumentnummer")], F.date_format("datum", "yyyy-MM-dd"), *[F.col(c) for c in ("redner", "rolle", "fraktion")], F.col("drucksachetyp"))


def evidence(hits: DataFrame, chunks: DataFrame, profile: Profile = SQLITE, index: Index | None = None) -> DataFrame:
    """The context of hits and their neighbours: one row of quellen and context. Texts are joined after the limit only."""
    ordered, chunks = context_chunks(hits, chunks, profile, index)
    blocks = chunks.join(F.broadcast(ordered), "chunk_id").select("ord", label_of_chunk().alias("head"), F.concat("titel", F.lit("\n"), "text").alias("body"))
    return fusion.build_context(blocks, profile.block_chars, profile.context_chars)


def excerpts(blocks: DataFrame, question: Asked, profile: Profile) -> DataFrame:
    """``blocks`` with column ``auszug``: the text, its best sentence between marks; as it is where no sentence has a word of the question.

    Sentences are ranked by the words that the profile's search finds: folded ones, or words of the same stem.
    """
    if profile.lexical == "bm25":
        tokens, wanted = index_tokens, question.terms
    else:
        stems = set(german.question_stems(blocks.sparkSession, question.words))
        own = blocks.select(F.explode(F.array_distinct(word_tokens(F.col("text")))).alias("w")).distinct()
        tokens, wanted = word_tokens, [r["w"] for r in own.collect() if german.stem(r["w"]) in stems]
    score = F.size(F.filter(tokens(F.col("satz")), lambda t: t.isin(wanted)))
    best = fusion.best_sentences(blocks, score).select("chunk_id", "satz")
    marked = F.when(F.col("satz").isNull(), F.col("text")).otherwise(fusion.mark_sentence(F.col("text"), F.col("satz")))
    return blocks.join(best, "chunk_id", "left").withColumn("auszug", marked).drop("satz")


def reranked(hits: DataFrame, chunks: DataFrame, question: str, generator: Generator, template: str, top_k: int) -> DataFrame:
    """(chunk_id, rank) of the ``top_k`` candidates that a model picks; in the order of ``hits`` where it fails or all fit."""
    hits = fusion.pinned(hits.select("chunk_id", "rank"))
    if hits.count() <= top_k:
        return hits
    lines = fusion.candidate_lines(chunks.join(F.broadcast(hits), "chunk_id")).first()["kandidaten"]
    prompt = template.replace("{frage}", question, 1).replace("{kandidaten}", lines, 1).replace("{anzahl}", str(top_k), 1)
    try:
        answer = generator.complete(prompt)
    except Exception:  # a pick that fails must not be worse than none
        answer = ""
    return fusion.rerank(hits, answer, top_k).withColumnRenamed("ord", "rank")


def analyse(generator: Generator, template: str, question: str) -> dict:
    """suchbegriffe and dokumentart of a question by the model; the raw question where it fails."""
    raw = generator.complete(template.replace("{frage}", question, 1))
    found = re.search(r"\{.*\}", raw, re.S)
    try:
        parsed = json.loads(found.group(0)) if found else {}
    except ValueError:
        parsed = {}
    kind = parsed.get("dokumentart")
    return {"suchbegriffe": parsed.get("suchbegriffe") or question, "dokumentart": kind if kind in answers.KINDS else None}


#: What a source tells beside its number and place.
_SOURCE = ("chunk_id", "titel", "datum", "dokumentnummer", "dokumentart", "drucksachetyp", "redner", "fraktion", "pdf_url")


def ask(
    chunks: DataFrame,
    vectors: DataFrame | None,
    question: str,
    generator: Generator,
    embedder: Embedder | None,
    analyse_template: str,
    answer_template: str,
    profile: Profile = SQLITE,
    language: str = "de",
    limit: int | None = None,
    index: Index | None = None,
    rerank_template: str | None = None,
    cells: ann.Cells | None = None,
) -> Iterator[dict]:
    """Events of one answer: analyse, quellen, text pieces, fertig; no hits end with a fixed text, errors and empty questions with fehler.

    With ``rerank_template`` ({frage}, {kandidaten}, {anzahl}) a model picks from more candidates. quellen has for each numbered
    block its label, document and excerpt with the best sentence marked.
    """
    if not question or not question.strip():
        yield {"typ": "fehler", "meldung": "Keine Frage übergeben."}
        return
    try:
        yield from _answer(chunks, vectors, question.strip(), generator, embedder, analyse_template, answer_template, profile, language if language in answers.LANGUAGES else "de", limit or profile.top_k, index, rerank_template, cells)
    except Exception as e:
        yield {"typ": "fehler", "meldung": str(e) or "Unbekannter Fehler"}


def _answer(chunks, vectors, question, generator, embedder, analyse_template, answer_template, profile, language, limit, index, rerank_template, cells) -> Iterator[dict]:
    spark = chunks.sparkSession
    analysis = analyse(generator, analyse_template, question)
    yield {"typ": "analyse", **analysis}
    vector = embedder.embed([question], QUERY)[0] if embedder is not None else None
    words = asked(spark, analysis["suchbegriffe"], profile)
    keep = filters(analysis["dokumentart"])
    hits = hybrid(chunks, vectors, words, vector, profile, keep, limit if rerank_template is None else fusion.RERANK_MOST, index, cells, zones(analysis["dokumentart"]))
    if rerank_template is not None:
        hits = reranked(hits, chunks, question, generator, rerank_template, limit)
    ordered, near = context_chunks(hits, chunks, profile, index)
    # A context holds few chunks: what the events tell of them is fetched.
    blocks = near.join(F.broadcast(ordered), "chunk_id")
    row = fusion.build_context(blocks.select("ord", label_of_chunk().alias("head"), F.concat("titel", F.lit("\n"), "text").alias("body")), profile.block_chars, profile.context_chars).first()
    if row is None or not row["quellen"]:
        yield {"typ": "text", "text": NO_HITS.get(language, NO_HITS["de"])}
        yield {"typ": "fertig"}
        return
    told = [c for c in _SOURCE if c in blocks.columns]
    known = {r["ord"]: r for r in excerpts(blocks, words, profile).select("ord", label_of_chunk().alias("quelle"), "auszug", *told).collect()}
    yield {"typ": "quellen", "quellen": [{"nummer": q["nummer"], "block": q["block"], "quelle": known[q["at"]]["quelle"], "auszug": known[q["at"]]["auszug"]} | {c: _plain(known[q["at"]][c]) for c in told} for q in row["quellen"]]}
    prompt = answer_template.replace("{frage}", question, 1).replace("{kontext}", row["context"], 1)
    for piece in generator.stream(prompt):
        yield {"typ": "text", "text": piece}
    yield {"typ": "fertig"}


def _plain(value):
    return value.isoformat() if isinstance(value, datetime.date) else value
