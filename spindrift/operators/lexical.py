"""Inverted index, BM25, document-frequency pruning and coverage ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, index_tokens

#: Constants of BM25 as the full-text index defines it, and the least idf.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Weights of the columns text and speaker.
WEIGHTS = {"text": 1.0, "redner": 0.5}


def weighted(column: str, weight: float, tokens: Callable[[Column], Column] = index_tokens) -> Column:
    """The tokens of a column as structs (term, w)."""
    return F.transform(tokens(F.col(column)), lambda t: F.struct(t.alias("term"), F.lit(float(weight)).alias("w")))


def postings(chunks: DataFrame, columns: dict[str, float] = WEIGHTS, id_: str = "chunk_id", tokens: Callable[[Column], Column] = index_tokens, sizes: bool = False, only: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(term, chunk_id, tf, hits): weighted and plain occurrences of each term in each chunk; with ``sizes`` also size, the chunk's tokens.

    Columns are tokenised apart and exploded together, so one shuffle counts them all. Other terms than those of ``only(term)`` end in the scan stage if it
    is broadcast, before they are counted. With ``parts`` texts are dealt by chunk into so many, so that what each holds is counted where it is cut and no token
    is shuffled.
    """
    chunks = chunks.repartition(parts, id_) if parts else chunks
    marked = F.concat(*[weighted(c, w, tokens) for c, w in columns.items()])
    rows = chunks.select(F.col(id_).alias("chunk_id"), F.explode(F.array(marked)).alias("ts")) if sizes else chunks.select(F.col(id_).alias("chunk_id"), marked.alias("ts"))
    own = [F.size("ts").cast("long").alias("size")] if sizes else []
    rows = rows.select("chunk_id", *own, F.explode_outer("ts").alias("t")).where("t is not null")
    if only is not None:
        rows = rows.join(only.select(F.col("term").alias("_only")), F.col("t.term") == F.col("_only"), "left_semi")
    keys = [F.col("t.term").alias("term"), "chunk_id", *(["size"] if sizes else [])]
    counted = rows.groupBy(*keys).agg(F.sum("t.w").alias("tf"), F.count("*").alias("hits"))
    return counted.select("term", "chunk_id", "tf", "hits", *(["size"] if sizes else []))


def lengths(chunks: DataFrame, columns: dict[str, float] = WEIGHTS, id_: str = "chunk_id") -> DataFrame:
    """(chunk_id, tokens) over all columns, unweighted."""
    sizes = [F.size(index_tokens(F.col(c))) for c in columns]
    total = sizes[0]
    for s in sizes[1:]:
        total = total + s
    return chunks.select(F.col(id_).alias("chunk_id"), total.cast("long").alias("tokens"))


def document_frequency(index: DataFrame, more_than: int = 0) -> DataFrame:
    """(term, ndoc) of terms that more than so many chunks hold."""
    return index.groupBy("term").agg(F.count_distinct("chunk_id").alias("ndoc")).where(F.col("ndoc") > more_than)


def terms_of(question: DataFrame, words: Column) -> DataFrame:
    """Distinct folded terms of a question; at most the 32 words that a question keeps."""
    return question.select(F.explode(words).alias("word")).select(fold(F.col("word")).alias("term")).where("term <> ''").distinct()


def cut_frequent(terms: DataFrame, frequency: DataFrame, max_df: float) -> DataFrame:
    """Terms whose document frequency is at most ``max_df``; all of them if none is. Unknown terms count 0.

    ``terms`` is a question's, so both it and the joined rows are small, and the frequencies are read once.
    """
    asked = frequency.join(F.broadcast(terms), "term", "left_semi")
    known = terms.join(F.broadcast(asked), "term", "left").select("term", F.coalesce("ndoc", F.lit(0)).cast("long").alias("ndoc"))
    rare = known.where(F.col("ndoc") <= max_df)
    any_rare = rare.agg((F.count("*") > 0).alias("any_rare"))
    return known.join(F.broadcast(any_rare)).where((F.col("ndoc") <= max_df) | ~F.col("any_rare")).select("term", "ndoc")


def bm25(chunks: DataFrame, terms: DataFrame, columns: dict[str, float] = WEIGHTS, id_: str = "chunk_id", keep: Column | None = None) -> DataFrame:
    """(chunk_id, score) of chunks with at least one term, the larger the better.

    Statistics are of all chunks, ``keep`` only filters what is returned. Rows that hold none of the question's
    terms end in the scan stage, since the terms are broadcast (at most 32).
    """
    marked = [weighted(c, w) for c, w in columns.items()]
    kept = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    rows = chunks.select(F.col(id_).alias("chunk_id"), kept.alias("kept"), F.concat(*marked).alias("tokens"))
    stats = rows.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("mean"))
    hits = rows.select("chunk_id", "kept", F.size("tokens").alias("size"), F.explode_outer("tokens").alias("t")).join(F.broadcast(terms.select("term")), F.col("t.term") == F.col("term"), "left_semi")
    per = hits.groupBy("chunk_id", "kept", "size", F.col("t.term").alias("term")).agg(F.sum("t.w").alias("tf"))
    # Counted by tf, which is never null, so that both uses of ``per`` are one shuffle and texts are cut once for them.
    df = per.groupBy("term").agg(F.count("tf").alias("df"))
    # df has a row for each term of the question at most.
    scored = per.where("kept").join(F.broadcast(df), "term").join(F.broadcast(stats))
    return scored.groupBy("chunk_id").agg(F.sum(_part()).alias("score"))


def bm25_indexed(per: DataFrame, frequency: DataFrame, count: int, mean: float, by: list[str] | None = None) -> DataFrame:
    """``bm25`` from stored ``per(term, chunk_id, tf, size)`` and ``frequency(term, ndoc)`` of a question's terms, and the numbers of all chunks.

    ``by`` names further columns of ``per``, for the scores of several questions at once.
    """
    known = frequency.select("term", F.col("ndoc").alias("df"))
    scored = per.join(F.broadcast(known), "term").withColumns({"n": F.lit(count), "mean": F.lit(float(mean))})
    return scored.groupBy(*(by or []), "chunk_id").agg(F.sum(_part()).alias("score"))


def _part() -> Column:
    """What a term adds to a chunk's score, from tf, df, size, n and mean."""
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    return idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))


def coverage(chunks: DataFrame, terms: DataFrame, columns: dict[str, float] = WEIGHTS, id_: str = "chunk_id") -> DataFrame:
    """(chunk_id, score): how often a chunk holds any of the terms. No idf and no length, as a cover-density rank of an OR query."""
    tokens = F.concat(*[index_tokens(F.col(c)) for c in columns])
    rows = chunks.select(F.col(id_).alias("chunk_id"), F.explode_outer(tokens).alias("token"))
    hits = rows.join(F.broadcast(terms.select("term")), F.col("token") == F.col("term"), "left_semi")
    return hits.groupBy("chunk_id").agg((F.count("*") * 0.1).alias("score"))


def top(scores: DataFrame, limit: int, order: list[Column]) -> DataFrame:
    """The first ``limit`` rows and their rank from 1; what is ranked is no more than the limit."""
    from pyspark.sql import Window

    best = scores.orderBy(*order).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
