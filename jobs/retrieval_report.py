"""Report of retrieval quality: every question of a set is searched in all documents, and what is found is held against the documents that quote it.

    python -m jobs.retrieval_report --documents DIR --questions DIR --output DIR [--label NAME] [--top_k N] [--buckets N]

A question's targets are the documents that hold its words in a row; its ranking is by BM25 of its terms. A run writes

* ``output/ranking/run=LABEL/bucket=B``: (item_id, rank, doc_id, score), the first ``top_k`` of each question,
* ``output/judged/run=LABEL/outcome=O``: (item_id, n_targets, first_rank, best_doc, best_score), O one of hit, miss and no_target,
* ``output/report/run=LABEL``: a line of JSON with the hit rate and the median of the first rank.

A run overwrites the folders of its own label alone, so it can be repeated, and runs of other labels stay to be compared.
"""

from __future__ import annotations

import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import joined, main, stored
from spindrift.functions.text import fold, index_tokens, match_terms
from spindrift.operators import evaluation, lexical
from spindrift.shipping import shared_folder

RANKING = "item_id long, rank int, doc_id long, score double, bucket int"
JUDGED = "item_id long, n_targets long, first_rank int, best_doc long, best_score double, outcome string"
LOG = logging.getLogger("jobs.retrieval_report")
#: Questions of a set and their characters; a larger one is reported in parts. These bound what is broadcast below: terms, texts and targets' rarest terms of questions.
QUESTIONS, CHARACTERS = 20_000, 32 << 20
#: The term that stands for a document itself, so that one pass gives its terms and its size.
_WHOLE = ""


def asked_terms(questions: DataFrame) -> DataFrame:
    """(frage_id, term): the distinct folded words by which a question is searched, 32 at most."""
    words = F.array_distinct(F.transform(match_terms(F.col("text")), fold))
    return questions.select("frage_id", F.explode(words).alias("term")).where(F.col("term") != _WHOLE)


def postings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, chunk_id, tf, size) of the wanted terms in all documents, with one row of the term ``_WHOLE`` for each document."""
    marked = lambda c: F.concat(F.array(F.lit(_WHOLE)), index_tokens(c))
    terms = wanted.unionByName(docs.sparkSession.createDataFrame([(_WHOLE,)], "term string"))
    found = lexical.postings(docs, {"text": 1.0}, tokens=marked, sizes=True, only=F.broadcast(terms))
    return found.select("term", "chunk_id", "tf", (F.col("size") - 1).alias("size"))


def ranked(per: DataFrame, asked: DataFrame, frequency: DataFrame, count: int, mean: float, top_k: int) -> DataFrame:
    """(frage_id, dokument, score, rank) of the best documents of each question."""
    own = frequency.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    # A document's terms lie in one task, so that its scores for all questions are summed there and only the best of each leave it.
    scores = lexical.bm25_indexed(per.repartition("chunk_id").join(F.broadcast(asked), "term"), own, count, mean, ["frage_id"])
    order = Window.partitionBy("frage_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("frage_id", F.col("chunk_id").alias("dokument"), F.round("score", 6).alias("score"), "rank")


def quoting(docs: DataFrame, questions: DataFrame, per: DataFrame, frequency: DataFrame) -> DataFrame:
    """(frage_id, ziel): documents that hold all tokens of a question in a row.

    Such a document holds the question's rarest token, so only documents that do are read, each once for all questions that it may quote.
    """
    asked = questions.select("frage_id", F.array_distinct(index_tokens(F.col("text"))).alias("ts"), F.array_join(index_tokens(F.col("text")), " ").alias("said"))
    known = asked.select("frage_id", F.explode("ts").alias("term")).join(F.broadcast(frequency), "term", "left")
    rarest = known.groupBy("frage_id").agg(F.min_by("term", F.struct(F.coalesce("ndoc", F.lit(0)), "term")).alias("term"))
    able = per.join(F.broadcast(rarest), "term").groupBy("chunk_id").agg(F.collect_set("frage_id").alias("ids"))
    texts = joined(docs, able, "chunk_id", "inner").select("chunk_id", "ids", F.concat(F.lit(" "), F.array_join(index_tokens(F.col("text")), " "), F.lit(" ")).alias("line"))
    pairs = texts.select("chunk_id", "line", F.explode("ids").alias("frage_id")).join(F.broadcast(asked.select("frage_id", "said")), "frage_id")
    held = pairs.where(F.contains("line", F.concat(F.lit(" "), "said", F.lit(" "))))
    return held.select("frage_id", F.col("chunk_id").alias("ziel")).distinct()


def run(spark: SparkSession, documents: str, questions: str, output: str, label: str = "current", top_k: int = 20, buckets: int = 8) -> dict:
    """Judges all questions over all documents and writes ranking, judged questions and report under ``label``; returns the report.

    ``documents(doc_id, text)`` are read whole; a null text is an empty document, a row without an id can neither be found nor be a target, rows of one id
    should be one document. ``questions(item_id, text)`` have an id each; one without words finds nothing and has no target.
    """
    output = output.rstrip("/")
    LOG.info("reading %s and %s, writing %s", documents, questions, output)
    shared_folder(spark)
    docs = spark.read.parquet(documents).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("chunk_id"), "text")
    asked_all = spark.read.parquet(questions).where("item_id is not null").select(F.col("item_id").cast("long").alias("frage_id"), F.coalesce("text", F.lit("")).alias("text"))
    number, characters = asked_all.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if number > QUESTIONS or characters > CHARACTERS:
        raise ValueError(f"{number} questions of {characters} characters: report them in sets of at most {QUESTIONS} and {CHARACTERS}")
    terms = asked_terms(asked_all).checkpoint()
    wanted = terms.select("term").union(asked_all.select(F.explode(index_tokens(F.col("text"))))).distinct().checkpoint()
    per = postings(docs, wanted).checkpoint()
    whole = per.where(F.col("term") == _WHOLE).agg(F.count("*").alias("n"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("mean")).first()
    per = per.where(F.col("term") != _WHOLE)
    frequency = per.groupBy("term").agg(F.count("*").alias("ndoc")).checkpoint()
    found = ranked(per, terms, frequency, whole["n"], whole["mean"], top_k).withColumn("bucket", F.pmod(F.xxhash64("frage_id"), F.lit(buckets)).cast("int"))
    found.select(F.col("frage_id").alias("item_id"), "rank", F.col("dokument").alias("doc_id"), "score", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{output}/ranking/run={label}")
    best = stored(spark, f"{output}/ranking/run={label}", RANKING).select(F.col("item_id").alias("frage_id"), "rank", F.col("doc_id").alias("dokument"), "score")
    goals = quoting(docs, asked_all, per, frequency).checkpoint()
    hits = evaluation.judge(best, goals, top_k)
    counts = goals.groupBy("frage_id").agg(F.count("*").alias("n_targets"))
    first = best.where("rank = 1").select("frage_id", F.col("dokument").alias("best_doc"), F.col("score").alias("best_score"))
    rows = asked_all.select("frage_id").join(counts, "frage_id", "left").join(hits, "frage_id", "left").join(first, "frage_id", "left")
    outcome = F.when(F.col("n_targets").isNull(), "no_target").when(F.col("first_rank").isNull(), "miss").otherwise("hit")
    out = rows.select(F.col("frage_id").alias("item_id"), F.coalesce("n_targets", F.lit(0)).alias("n_targets"), "first_rank", "best_doc", "best_score", outcome.alias("outcome"))
    out.write.mode("overwrite").partitionBy("outcome").parquet(f"{output}/judged/run={label}")
    measured = evaluation.metrics(judged(spark, output, label).where("outcome <> 'no_target'")).withColumns({"questions": F.lit(number), "documents": F.lit(whole["n"]), "top_k": F.lit(top_k)})
    measured.coalesce(1).write.mode("overwrite").json(f"{output}/report/run={label}")
    told = measured.first().asDict()
    LOG.info("read %d documents and %d questions; %d of %d questions with a target were hit, median rank %s; wrote run %s", whole["n"], number, told["treffer"], told["fragen"], told["median_rang"], label)
    return told


def judged(spark: SparkSession, output: str, label: str = "current") -> DataFrame:
    """The judged questions of a run."""
    return stored(spark, f"{output.rstrip('/')}/judged/run={label}", JUDGED)


if __name__ == "__main__":
    main(sys.argv[1:], "retrieval_report", Path(__file__).with_suffix(".json"), run, __doc__)
