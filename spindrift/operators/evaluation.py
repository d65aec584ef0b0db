"""Retrieval quality: hit rate, rank of the first hit, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE

#: Characters of a candidate's text that an evaluation shows.
PREVIEW = 240


def judge(ranked: DataFrame, targets: DataFrame, top_k: int) -> DataFrame:
    """(frage_id, first_rank) for each question of ``targets(frage_id, ziel)``; null if no target is in the first ``top_k``.

    ``ranked(frage_id, dokument, rank)`` are results; any target found counts.
    """
    hits = ranked.where(F.col("rank") <= top_k).join(targets, (ranked.frage_id == targets.frage_id) & (ranked.dokument == targets.ziel), "inner")
    found = hits.groupBy(ranked.frage_id).agg(F.min("rank").alias("first_rank"))
    return targets.select("frage_id").distinct().join(found, "frage_id", "left")


def metrics(judged: DataFrame) -> DataFrame:
    """fragen, treffer, trefferquote and the median of the first rank over hits."""
    return judged.agg(
        F.count("*").alias("fragen"),
        F.count("first_rank").alias("treffer"),
        (F.count("first_rank") / F.nullif(F.count("*"), F.lit(0))).alias("trefferquote"),
        F.median("first_rank").alias("median_rang"),
    )


def failures(judged: DataFrame, ranked: DataFrame, found: int = 5) -> DataFrame:
    """(frage_id, gefunden): the first documents of each question without a hit."""
    missed = judged.where("first_rank is null").select("frage_id")
    first = ranked.where(F.col("rank") <= found).join(missed, "frage_id", "left_semi")
    lists = first.groupBy("frage_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "dokument"))), lambda x: x["dokument"]).alias("gefunden"))
    return missed.join(lists, "frage_id", "left").withColumn("gefunden", F.coalesce("gefunden", F.array().cast("array<long>")))


def uncached(questions: DataFrame, cache: DataFrame, key: str = "frage") -> DataFrame:
    """Questions whose analysis and vector are not cached yet."""
    return questions.join(cache.select(key), key, "left_anti")


def search_terms(words: Column) -> Column:
    """The terms of an analysed question: its words between white space, in order, repeats included; none of null."""
    return F.filter(F.split(F.coalesce(words, F.lit("")), f"{SPACE}+", -1), lambda w: w != "")


def candidate_rows(ranked: DataFrame, chunks: DataFrame, documents: DataFrame, chars: int = PREVIEW) -> DataFrame:
    """(frage_id, rank, chunk_id, dokumentnummer, dokumentart, drucksachetyp, anriss, titel) of ``ranked(frage_id, chunk_id, rank)``.

    ``anriss`` is the first ``chars`` code points of the chunk's text, cut in the scan, so that no whole text is shuffled. Chunks
    without a document are left out.
    """
    found = ranked.select("frage_id", "rank", "chunk_id").join(chunks.select("chunk_id", "document_id", F.left("text", F.lit(chars)).alias("anriss")), "chunk_id")
    names = documents.select(F.col("id").alias("document_id"), "dokumentnummer", "dokumentart", "drucksachetyp", "titel")
    return found.join(names, "document_id").select("frage_id", "rank", "chunk_id", "dokumentnummer", "dokumentart", "drucksachetyp", "anriss", "titel")


def read_questions(spark, path: str) -> DataFrame:
    """(frage_id, frage, art, ziele) of a set ``{fragen: [{frage, ziele, art}]}``; numbered in order."""
    schema = "hinweis string, fragen array<struct<frage:string, ziele:array<string>, art:string>>"
    nested = spark.read.option("multiLine", True).schema(schema).json(path)
    return nested.select(F.posexplode("fragen").alias("frage_id", "f")).select("frage_id", "f.frage", "f.art", "f.ziele")


def targets(questions: DataFrame) -> DataFrame:
    """(frage_id, ziel) of positive questions; negative ones have none."""
    return questions.select("frage_id", F.explode("ziele").alias("ziel"))


def report(row, misses, milliseconds: float | None = None) -> str:
    """A few lines of text from a row of ``metrics`` and those of ``failures``; with the milliseconds of a question if they are known."""
    lines = [f"Treffer: {row['treffer']}/{row['fragen']} ({100 * (row['trefferquote'] or 0):.0f} %)", f"Median des ersten Rangs: {row['median_rang']}"]
    lines += [] if milliseconds is None else [f"Zeit je Frage: {milliseconds:.0f} ms"]
    return "\n".join(lines + [f"- {m['frage_id']}: gefunden {', '.join(map(str, m['gefunden']))}" for m in misses])
