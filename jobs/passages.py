"""Incremental job: files of documents that are new since the last run are cut into passages.

    python -m jobs.passages --documents DIR --output DIR --checkpoint DIR [--buckets N] [--files_per_batch N]

Spark's file stream keeps in the checkpoint which files were taken; each run takes the others (``availableNow``) and ends. A batch writes

* ``output/passages/batch=K/bucket=B``: (doc_id, position, passage_id, text, n_chars, lang, source),
* ``output/documents/batch=K``: (doc_id, digest, n_passages, lang, source), a row for each document that the batch cut anew,
* ``output/rejected/batch=K``: rows without a doc_id, as they came.

A batch that runs again, after a crash between its writes too, overwrites its own folders with the same rows. ``current`` reads what holds now: of every
document the passages of the last batch that cut it.
"""

from __future__ import annotations

import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import joined, main, stored
from spindrift.operators import maintenance, segment
from spindrift.streaming.windows import pattern

LOG = logging.getLogger("jobs.passages")
PASSAGES = "doc_id long, position int, passage_id long, text string, n_chars int, lang string, source string, bucket int"
DOCUMENTS = "doc_id long, digest string, n_passages long, lang string, source string"
#: The column of the folders of batches.
BATCH = ", batch long"


def arrivals(batch: DataFrame) -> DataFrame:
    """(doc_id, text, lang, source, digest): of several rows of an id the one of the last file, then of the last digest.

    Rows of ids that come once are not shuffled.
    """
    rows = batch.where("doc_id is not null").withColumn("digest", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    repeated = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    order = F.struct("arrived", "file", "digest")
    many = maintenance.latest(joined(rows, repeated, "doc_id", "left_semi").withColumn("order", order), "doc_id", "order")
    names = ["doc_id", "text", "lang", "source", "digest"]
    return joined(rows, repeated, "doc_id", "left_anti").select(*names).unionByName(many.select(*names))


def changed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` without those whose text is the one that was cut last; what is compared is ids and digests, not texts."""
    last = known.groupBy("doc_id").agg(F.max_by("digest", "batch").alias("cut"))
    same = rows.select("doc_id", "digest").join(last, "doc_id").where("digest = cut").select("doc_id")
    return joined(rows, same, "doc_id", "left_anti")


def cut(rows: DataFrame, buckets: int) -> DataFrame:
    """Passages of documents; what is written together is dealt by bucket, in parts of the size that the session advises."""
    found = segment.segment_papers(rows, "doc_id", keep=["lang", "source"]).withColumnRenamed("document_id", "doc_id")
    passage = segment.chunk_id(F.col("doc_id"), F.col("position")).alias("passage_id")
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket")
    return found.select("doc_id", "position", passage, "text", F.length("text").alias("n_chars"), "lang", "source", bucket).hint("rebalance", "bucket")


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, buckets: int = 16, files_per_batch: int = 0) -> dict[str, int]:
    """Takes the new files of ``documents`` into ``output``; returns how many batches, rows, documents and passages there were.

    A file counts as new by its name, so changed documents come in new files. A document whose text is as it was cut last is left alone; one that is empty
    or too short now has no passages any more. ``files_per_batch`` bounds a batch, 0 takes all that is there as one. Columns beside doc_id, text, lang and
    source are not read; null languages and sources stay null.
    """
    output, done = output.rstrip("/"), {"batches": 0, "rows": 0, "documents": 0, "passages": 0, "rejected": 0}

    def take(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        read = batch.count()
        known = stored(own, f"{output}/documents", DOCUMENTS + BATCH).where(F.col("batch") < number)
        rows = arrivals(batch)
        if number:
            rows = changed(rows, known)
        cut(rows, buckets).write.mode("overwrite").partitionBy("bucket").parquet(f"{output}/passages/batch={number}")
        written = stored(own, f"{output}/passages/batch={number}", PASSAGES)
        counts = written.groupBy("doc_id").agg(F.count("*").alias("n_passages"))
        ledger = rows.select("doc_id", "digest", "lang", "source").join(counts, "doc_id", "left")
        ledger.select("doc_id", "digest", F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"), "lang", "source").write.mode("overwrite").parquet(f"{output}/documents/batch={number}")
        lost = batch.where("doc_id is null").select("text", "lang", "source", "file")
        lost.write.mode("overwrite").parquet(f"{output}/rejected/batch={number}")
        told = stored(own, f"{output}/documents/batch={number}", DOCUMENTS).agg(F.count("*").alias("d"), F.coalesce(F.sum("n_passages"), F.lit(0)).alias("p")).first()
        rejected = own.read.parquet(f"{output}/rejected/batch={number}").count()
        LOG.info("batch %d: read %d rows, cut %d documents into %d passages, put %d rows without an id aside", number, read, told["d"], told["p"], rejected)
        for name, n in (("batches", 1), ("rows", read), ("documents", told["d"]), ("passages", told["p"]), ("rejected", rejected)):
            done[name] += n

    LOG.info("reading %s, writing %s", documents, output)
    reader = spark.readStream.schema(spark.read.parquet(documents).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    arrived = reader.parquet(pattern(documents)).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("_metadata.file_modification_time").alias("arrived"), F.col("_metadata.file_path").alias("file"))
    query = arrived.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("read %d rows in %d batches, wrote %d documents and %d passages", done["rows"], done["batches"], done["documents"], done["passages"])
    return done


def current(spark: SparkSession, output: str) -> DataFrame:
    """(doc_id, position, passage_id, text, n_chars, lang, source) of every document as it was cut last, batches whose documents are not written yet left out.

    Only what a later batch cut again is looked up, so passages are not shuffled.
    """
    output = output.rstrip("/")
    known, passages = stored(spark, f"{output}/documents", DOCUMENTS + BATCH), stored(spark, f"{output}/passages", PASSAGES + BATCH)
    again = known.groupBy("doc_id").agg(F.max("batch").alias("last"), F.count("*").alias("n")).where("n > 1").select("doc_id", "last")
    whole = joined(passages, known.select("batch").distinct(), "batch", "left_semi")
    last = joined(whole, again, "doc_id", "left").where("last is null or batch = last")
    return last.select("doc_id", "position", "passage_id", "text", "n_chars", "lang", "source")


if __name__ == "__main__":
    main(sys.argv[1:], "passages", Path(__file__).with_suffix(".json"), run, __doc__)
