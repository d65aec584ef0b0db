"""Fusion of ranked lists, neighbours, evidence context, re-ranking and highlights."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, strip
from ..shipping import shared_folder

RRF_K = 60
#: How sentences of a highlight are told apart, what one starts with, its lengths, its marks.
HIGHLIGHT_BREAK = r"(?U)(?<=[^0-9][.!?])\s+(?=[A-ZÄÖÜ„\"(])"
HIGHLIGHT_START = r'^[A-ZÄÖÜ„"(]'
HIGHLIGHT_CHARS = (30, 350)
MARK_ON, MARK_OFF = "\u0001", "\u0002"
RERANK_MOST, TEASER = 60, 200
SEPARATOR = "\n\n---\n\n"


def fuse(lists: Mapping[str, tuple[DataFrame, float]], limit: int, k: int = RRF_K) -> DataFrame:
    """(chunk_id, score, found_by, rank) by reciprocal ranks of ``name -> (chunk_id and rank, weight)``.

    Ties keep the order of first insertion: the rank in the first list, then in the next. Lists are
    candidates of one question, so what is fused is small.
    """
    rows = None
    for n, (name, (hits, weight)) in enumerate(lists.items()):
        part = hits.select("chunk_id", F.col("rank").cast("int").alias("r"), F.lit(n).alias("list"), F.lit(name).alias("name"), F.lit(float(weight)).alias("w"))
        rows = part if rows is None else rows.unionByName(part)
    firsts = [F.min(F.when(F.col("list") == n, F.col("r"))).alias(f"r{n}") for n in range(len(lists))]
    found = F.transform(F.array_sort(F.collect_list(F.struct("list", "name"))), lambda x: x["name"]).alias("found_by")
    fused = rows.groupBy("chunk_id").agg(F.sum(F.col("w") / (k + F.col("r"))).alias("score"), found, *firsts)
    order = [F.round("score", 12).desc(), *[F.col(f"r{n}").asc_nulls_last() for n in range(len(lists))]]
    best = fused.orderBy(*order).limit(limit)
    return best.select("chunk_id", "score", "found_by", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def pinned(hits: DataFrame, most: int = 1000) -> DataFrame:
    """``hits`` as rows of the plan: a search's few best are fetched once instead of being searched for by each use of them.

    More than ``most`` go to a checkpoint instead.
    """
    rows = hits.limit(most + 1).collect()
    if len(rows) > most:
        shared_folder(hits.sparkSession)
        return hits.checkpoint()
    return hits.sparkSession.createDataFrame(rows, hits.schema)


def neighbours(hits: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """Neighbours of ``hits(chunk_id, rank)`` within ``window`` positions of the same document: (chunk_id, owner_rank, position).

    Hits themselves are none; each neighbour belongs to the first hit that reaches it. Chunks are only
    scanned: hits and their places are few and broadcast.
    """
    at = chunks.select("chunk_id", "document_id", "position")
    placed = at.join(F.broadcast(hits.select("chunk_id", "rank")), "chunk_id").select(F.col("document_id").alias("hdoc"), F.col("position").alias("hpos"), "rank")
    reach = placed.withColumn("npos", F.explode(F.sequence(F.col("hpos") - window, F.col("hpos") + window)))
    first = reach.groupBy("hdoc", "npos").agg(F.min("rank").alias("owner_rank"))
    near = at.join(F.broadcast(first), (F.col("document_id") == F.col("hdoc")) & (F.col("position") == F.col("npos")))
    return near.join(F.broadcast(hits.select("chunk_id")), "chunk_id", "left_anti").select("chunk_id", "owner_rank", "position")


def with_neighbours(hits: DataFrame, chunks: DataFrame, window: int = 1, order: str = "interleaved") -> DataFrame:
    """(chunk_id, ord, is_neighbour): hits with neighbours after their hit (``interleaved``) or after all hits (``appended``)."""
    hits = pinned(hits.select("chunk_id", "rank"))  # no job where they are rows already
    own = hits.select("chunk_id", F.col("rank").alias("owner_rank"), F.lit(0).alias("position"), F.lit(0).alias("is_neighbour"))
    rows = own
    if window > 0:
        rows = own.unionByName(neighbours(hits, chunks, window).select("chunk_id", "owner_rank", F.col("position").cast("int").alias("position"), F.lit(1).alias("is_neighbour")))
    keys = ["owner_rank", "is_neighbour", "position", "chunk_id"] if order == "interleaved" else ["is_neighbour", "owner_rank", "position", "chunk_id"]
    return rows.select("chunk_id", F.row_number().over(Window.orderBy(*keys)).alias("ord"), (F.col("is_neighbour") == 1).alias("is_neighbour"))


def source_label(kind: Column, number: Column, date: Column, speaker: Column, role: Column, party: Column, subtype: Column | None = None) -> Column:
    """``{subtype or kind} {number} vom {date}[, {speaker}[ ({party or role})]]``; empty strings count as missing."""
    some = lambda c: F.nullif(c, F.lit(""))
    head = F.concat(F.coalesce(some(subtype) if subtype is not None else F.lit(None).cast("string"), kind), F.lit(" "), number, F.lit(" vom "), date)
    attribute = F.coalesce(some(party), some(role))
    who = F.concat(F.lit(", "), some(speaker), F.coalesce(F.concat(F.lit(" ("), attribute, F.lit(")")), F.lit("")))
    return F.concat(head, F.coalesce(who, F.lit("")))


def accepted(rows: Column, max_block: int = 8_000, max_total: int = 60_000) -> Column:
    """Of an ordered array of (head, body) those that fit, as (nummer, at, block): too large ones are skipped, later ones may still fit.

    A block is ``[n] head``, a line feed and the body, where n counts accepted ones; separators are free.
    """

    def add(state: Column, x: Column) -> Column:
        block = F.concat(F.lit("["), (F.size(state["out"]) + 1).cast("string"), F.lit("] "), x["head"], F.lit("\n"), x["body"])
        size = F.length(block)
        taken = F.struct(F.concat(state["out"], F.array(F.struct((F.size(state["out"]) + 1).alias("nummer"), x["at"].alias("at"), block.alias("block")))).alias("out"), (state["used"] + size).alias("used"))
        return F.when((size <= max_block) & (state["used"] + size <= max_total), taken).otherwise(state)

    start = F.struct(F.array().cast("array<struct<nummer:int,at:int,block:string>>").alias("out"), F.lit(0).alias("used"))
    return F.aggregate(rows, start, add, lambda s: s["out"])


def build_context(hits: DataFrame, max_block: int = 8_000, max_total: int = 60_000, by: list[str] | None = None) -> DataFrame:
    """One row (for each ``by``): context string and quellen array of (nummer, at, block) from ``hits(ord, head, body)``.

    Hits are those of one question, so they are gathered into one array, in order.
    """
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col("ord").cast("int").alias("at"), "head", "body"))), lambda x: x)
    out = hits.groupBy(*(by or [])).agg(accepted(rows, max_block, max_total).alias("quellen"))
    return out.withColumn("context", F.array_join(F.transform("quellen", lambda q: q["block"]), SEPARATOR))


def candidate_lines(candidates: DataFrame, chars: int = TEASER) -> DataFrame:
    """One row, column ``kandidaten``: a numbered line for each of the first ``RERANK_MOST`` of ``candidates(rank, drucksachetyp, dokumentart, dokumentnummer, text)``.

    A line is ``n. [kind number] text``, white space in the text as single spaces, its first ``chars`` characters.
    """
    kind = F.coalesce(F.nullif(F.col("drucksachetyp"), F.lit("")), F.col("dokumentart"), F.lit(""))
    text = F.left(strip(F.regexp_replace(F.coalesce("text", F.lit("")), f"{SPACE}+", " ")), F.lit(chars))
    line = F.concat(F.col("rank").cast("string"), F.lit(". ["), kind, F.lit(" "), F.coalesce("dokumentnummer", F.lit("")), F.lit("] "), text)
    rows = candidates.where(F.col("rank") <= RERANK_MOST).select("rank", line.alias("line"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("kandidaten"))


def rerank(candidates: DataFrame, answer: Column | str, top_k: int) -> DataFrame:
    """(chunk_id, ord) from ``candidates(chunk_id, rank)`` and a model's answer: its first ``[...]`` of candidate numbers from 1.

    Only the first ``RERANK_MOST`` candidates can be picked. Of a list that holds other things the whole numbers count, in
    their order; numbers of no candidate are ignored, repeated ones stay, the rest is filled up in the order of the
    candidates. An answer without a list, one that is no JSON, or candidates that all fit, leave that order.
    """
    text = F.lit(answer) if isinstance(answer, str) else answer
    found = F.regexp_extract(text, r"\[[^\]]*\]", 0)
    parts = F.transform(F.split(F.substring(found, F.lit(2), F.length(found) - 2), ",", -1), lambda p: F.trim(p, F.lit(" \t\r\n")))
    whole = F.transform(F.filter(parts, lambda p: p.rlike(r"^-?[0-9]+$")), lambda p: p.try_cast("int"))
    picks = F.when(F.from_json(found, "array<string>").isNotNull(), whole)
    one = candidates.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "chunk_id"))).alias("c"))
    one = one.withColumn("p", F.filter(F.coalesce(picks, F.array().cast("array<int>")), lambda p: p.isNotNull() & (p >= 1) & (p <= F.least(F.size("c"), F.lit(RERANK_MOST))) & (F.size("c") > top_k)))
    chosen = F.transform("p", lambda p: F.try_element_at(F.col("c"), p)["chunk_id"])
    rest = F.transform(F.filter("c", lambda c, k: ~F.array_contains(F.col("p"), k + 1)), lambda c: c["chunk_id"])
    return one.select(F.posexplode(F.slice(F.concat(chosen, rest), 1, top_k)).alias("k", "chunk_id")).select("chunk_id", (F.col("k") + 1).alias("ord"))


def best_sentences(chunks: DataFrame, score: Column, id_: str = "chunk_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(chunk_id, satz, score): for each chunk its best sentence by ``score`` of column ``satz``.

    Sentences of 30 to 350 characters that start like one and score above 0; then the best score,
    the shortest, the earliest. ``keep`` names columns that the score reads besides.
    """
    low, high = HIGHLIGHT_CHARS
    rows = chunks.select(F.col(id_).alias("chunk_id"), *(keep or []), F.posexplode_outer(F.split(F.col(text), HIGHLIGHT_BREAK, -1)).alias("pos", "satz"))
    rows = rows.where(F.length("satz").between(low, high) & F.col("satz").rlike(HIGHLIGHT_START)).withColumn("score", score).where("score > 0")
    first = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.col("score").desc(), F.length("satz"), "pos"))
    return rows.withColumn("_n", first).where("_n = 1").select("chunk_id", "satz", "score")


def mark_sentence(text: Column, sentence: Column) -> Column:
    """``text`` with the first occurrence of ``sentence`` between marks; as it is where there is none."""
    at = F.instr(text, sentence)
    marked = F.concat(F.substring(text, F.lit(1), at - 1), F.lit(MARK_ON), sentence, F.lit(MARK_OFF), F.substring(text, at + F.length(sentence), F.length(text)))
    return F.when((at > 0) & (F.length(sentence) > 0), marked).otherwise(text)
