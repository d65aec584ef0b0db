"""Latest-wins upserts, replaced chunks, resync, work queues and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_title, first_filled

#: Columns of a stored document that an update changes; the others keep what the first version had.
UPDATED = ("titel", "datum", "pdf_url", "aktualisiert", "text_len", "status")
FIXED = ("dokumentart", "dokumentnummer", "drucksachetyp", "wahlperiode", "herausgeber")
#: Documents of fewer chunks are embedded before larger ones.
SMALL_DOCUMENT = 500


def incoming(raw: DataFrame) -> DataFrame:
    """Rows of the documents table from raw records, with ``text`` and ``seq`` if they are there."""
    text = F.coalesce("text", F.lit(""))
    keep = [F.col(c) for c in ("seq",) if c in raw.columns]
    return raw.select(
        F.col("id").cast("long").alias("id"),
        first_filled(F.col("dokumentart"), F.col("fundstelle.dokumentart")).alias("dokumentart"),
        first_filled(F.col("dokumentnummer")).alias("dokumentnummer"),
        "drucksachetyp",
        clean_title(F.col("titel")).alias("titel"),
        first_filled(F.col("datum"), F.col("fundstelle.datum")).alias("datum"),
        "wahlperiode", "herausgeber",
        F.col("fundstelle.pdf_url").alias("pdf_url"),
        "aktualisiert",
        F.length(text).alias("text_len"),
        status(text).alias("status"),
        text.alias("text"), *keep,
    )


def status(text: Column) -> Column:
    """``pending`` without a full text, else ``fetched``."""
    return F.when(F.coalesce(text, F.lit("")) == "", "pending").otherwise("fetched")


def latest(rows: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """One row for each key: the last by ``order``; one shuffle of what the map side has left of each key."""
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(F.col(order))).alias("_row"))
    return best.select(key, "_row.*")


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The stored table after ``new`` (one row an id), with ``changed``: whether the document must be cut anew.

    A row is unchanged if both aktualisiert and text_len are as stored. An update touches the columns in
    ``UPDATED`` and clears chunked_at.
    """
    s, n = stored.alias("s"), new.alias("n")
    both = s.join(n, F.col("s.id") == F.col("n.id"), "full_outer")
    is_new, is_old = F.col("s.id").isNull(), F.col("n.id").isNull()
    same = F.col("s.aktualisiert").eqNullSafe(F.col("n.aktualisiert")) & F.col("s.text_len").eqNullSafe(F.col("n.text_len"))
    changed = F.when(is_old, F.lit(False)).otherwise(is_new | ~same)
    cols = [F.coalesce("s.id", "n.id").alias("id")]
    cols += [F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in FIXED]
    cols += [F.when(changed, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in UPDATED]
    return both.select(*cols, F.when(~changed, F.col("s.chunked_at")).alias("chunked_at"), changed.alias("changed"))


def replace_chunks(stored: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """Chunks after the documents ``changed(document_id)`` were cut anew: all their old chunks go, also where none are new."""
    ids = changed.select("document_id").distinct()
    return stored.join(ids, "document_id", "left_anti").unionByName(new.join(ids, "document_id", "left_semi"))


def content_hash(chunks: DataFrame) -> DataFrame:
    """(document_id, n, hash): number of chunks and a hash of all of them that does not depend on their order of rows."""
    one = F.xxhash64("position", "text")
    return chunks.groupBy("document_id").agg(F.count("*").alias("n"), F.sum(one.cast("decimal(38,0)")).alias("hash"))


def resync(source: DataFrame, target: DataFrame, by: str = "hash") -> DataFrame:
    """(document_id, action): ``replace`` where chunks differ, ``delete`` where the source has none.

    ``by`` hash also sees edits that keep the number of chunks; ``count`` compares numbers alone.
    """
    return differences(content_hash(source), content_hash(target), by)


def differences(source: DataFrame, target: DataFrame, by: str = "hash") -> DataFrame:
    """``resync`` of two tables of ``content_hash``."""
    s, t = source.alias("s"), target.alias("t")
    both = s.join(t, F.col("s.document_id") == F.col("t.document_id"), "full_outer")
    differ = ~F.col("s.n").eqNullSafe(F.col("t.n"))
    if by == "hash":
        differ = differ | ~F.col("s.hash").eqNullSafe(F.col("t.hash"))
    action = F.when(F.col("s.document_id").isNull(), "delete").when(differ, "replace")
    return both.select(F.coalesce("s.document_id", "t.document_id").alias("document_id"), action.alias("action")).where("action is not null")


def unequal_buckets(source: DataFrame, target: DataFrame, bucket: Column) -> list[int]:
    """Buckets in which two tables of ``content_hash`` differ, by one digest over the documents of each: what is fetched is as many rows as there are buckets.

    The digest sums over documents, so their order of rows makes no difference, and it holds their ids, numbers of chunks and hashes.
    """
    one = F.xxhash64("document_id", "n", "hash").cast("decimal(38,0)")
    s, t = (d.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(one).alias("digest")) for d in (source, target))
    s, t = s.alias("s"), t.alias("t")
    both = s.join(t, F.col("s.bucket") == F.col("t.bucket"), "full_outer")
    differ = ~(F.col("s.n").eqNullSafe(F.col("t.n")) & F.col("s.digest").eqNullSafe(F.col("t.digest")))
    return sorted(r[0] for r in both.where(differ).select(F.coalesce("s.bucket", "t.bucket")).collect())


def resume(source: DataFrame, target: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``source`` beyond the greatest key that ``target`` has."""
    done = target.agg(F.max(key).alias("_done"))
    return source.join(F.broadcast(done), F.col("_done").isNull() | (F.col(key) > F.col("_done"))).drop("_done")


def unembedded(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks that have no vector yet, which makes embedding resumable."""
    return chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def embed_queue(chunks: DataFrame, documents: DataFrame, vectors: DataFrame, limit: int | None = None, small: int = SMALL_DOCUMENT) -> DataFrame:
    """(chunk_id, prioritaet) of open chunks: transcripts, then documents of fewer than ``small`` chunks, then the rest; by id."""
    sizes = chunks.groupBy("document_id").agg(F.count("*").alias("n"))
    kinds = documents.select(F.col("id").alias("document_id"), "dokumentart").join(sizes, "document_id")
    first = F.when(F.col("dokumentart") == "Plenarprotokoll", 0).when(F.col("n") < small, 1).otherwise(2)
    queue = unembedded(chunks, vectors).join(kinds, "document_id").select("chunk_id", first.alias("prioritaet"))
    queue = queue.orderBy("prioritaet", "chunk_id")
    return queue if limit is None else queue.limit(limit)


def stats(documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of counts, each table read once."""
    d = documents.agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "pending").alias("ohne_volltext"), F.count_if(F.col("status") == "chunked").alias("gechunkt"))
    c = chunks.agg(F.count("*").alias("chunks"), F.count_if("embedded").alias("chunks_mit_embedding"))
    return d.crossJoin(c).crossJoin(vectors.agg(F.count("*").alias("vektoren")))


def orphans(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks without a document."""
    return chunks.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti")


def duplicate_positions(chunks: DataFrame) -> DataFrame:
    """(document_id, position, n) that break the uniqueness of a chunk's place."""
    return chunks.groupBy("document_id", "position").agg(F.count("*").alias("n")).where("n > 1")


def numbered(chunks: DataFrame) -> DataFrame:
    """Positions from 0 by ``ord`` within each document."""
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("ord")) - 1
    return chunks.withColumn("position", place)
