"""German stems by the published Snowball rules, and stopwords that Spark ships."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import shared_folder, shipped

# Fixed values of the published algorithm: vowels and the letters that may stand before s and st.
VOWELS = "aeiouyäöü"
BEFORE_S, BEFORE_ST = "bdfghklmnrt", "bdfghklmnt"


def _region(word: str, start: int) -> int:
    """Where the part after the first consonant behind a vowel begins, from ``start`` on."""
    for k in range(start + 1, len(word)):
        if word[k] not in VOWELS and word[k - 1] in VOWELS:
            return k + 1
    return len(word)


def _longest(word: str, suffixes: str) -> str:
    return max((s for s in suffixes.split() if word.endswith(s)), key=len, default="")


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    w = word.replace("ß", "ss")
    w = "".join(c.upper() if c in "uy" and 0 < k < len(w) - 1 and w[k - 1] in VOWELS and w[k + 1] in VOWELS else c for k, c in enumerate(w))
    r1 = _region(w, 0)
    r2 = _region(w, r1)
    r1 = max(r1, 3)

    found = _longest(w, "em ern er e en es s")
    if found and len(w) - len(found) >= r1 and (found != "s" or w[-2:-1] in tuple(BEFORE_S)):
        w = w[: -len(found)]
        if found in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]

    found = _longest(w, "en er est st")
    if found and len(w) - len(found) >= r1 and (found != "st" or (len(w) >= 6 and w[-3] in BEFORE_ST)):
        w = w[: -len(found)]

    found = _longest(w, "end ung ig ik isch lich heit keit")
    if found and len(w) - len(found) >= r2:
        base = w[: -len(found)]
        if found in ("end", "ung"):
            w = base
            if w.endswith("ig") and len(w) - 2 >= r2 and not w.endswith("eig"):
                w = w[:-2]
        elif found in ("ig", "ik", "isch"):
            if not base.endswith("e"):
                w = base
        elif found in ("lich", "heit"):
            w = base
            if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                w = w[:-2]
        else:
            w = base
            more = _longest(w, "lich ig")
            if more and len(w) - len(more) >= r2:
                w = w[: -len(more)]
    return w.lower().translate(str.maketrans("äöü", "aou"))


@lru_cache(maxsize=1 << 17)
def stem_of(word: str) -> str:
    """``stem``, of which a worker keeps some: texts repeat most of their words."""
    return stem(word)


def stopwords(spark: SparkSession) -> list[str]:
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("german")


@lru_cache(maxsize=1)
def stopwords_of(spark: SparkSession) -> frozenset[str]:
    return frozenset(stopwords(spark))


def question_stems(spark: SparkSession, words: list[str]) -> list[str]:
    """Distinct stems of a question's words, in order, without stopwords."""
    stop = stopwords_of(spark)
    return list(dict.fromkeys(stem(w) for w in (x.lower() for x in words) if w not in stop))


def stems(words: DataFrame, column: str = "term") -> DataFrame:
    """(word, stem) of distinct lower-case words that are no stopwords. Each word goes through Python once."""
    shipped(words.sparkSession)
    stop = stopwords_of(words.sparkSession)

    # A step that plans do not look into: a filter on a column of stems would be moved before the distinct, and stem each occurrence.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(w, stem(w)) for w in b.column(0).to_pylist() if w not in stop]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], names=["word", "stem"])

    distinct = words.select(F.lower(F.col(column)).alias("word")).where("word is not null").distinct()
    # A vocabulary is small beside what its stems cost: all cores take a part.
    distinct = distinct.repartition(max(words.sparkSession.sparkContext.defaultParallelism, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "word")
    return distinct.mapInArrow(run, "word string, stem string")


def stem_hits(tokens: DataFrame, wanted: list[str]) -> DataFrame:
    """(term, chunk_id, hits) of the ``wanted`` stems in ``tokens(chunk_id, ...)``, whose other columns are arrays of lower-case words: counted where they are cut.

    Each word is stemmed once for a batch; stopwords have no stem. A chunk is one row of ``tokens``.
    """
    shipped(tokens.sparkSession)
    stop, of = stopwords_of(tokens.sparkSession), {s: k for k, s in enumerate(wanted)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.columns[1:]
            row = np.concatenate([np.repeat(np.arange(b.num_rows), pc.list_value_length(x).to_numpy(zero_copy_only=False)) for x in lists])
            if not len(row):
                continue
            words = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
            at = np.array([-1 if w in stop else of.get(stem_of(w), -1) for w in words.dictionary.to_pylist()], dtype=np.int64)[words.indices.to_numpy()]
            key, hits = np.unique(row[at >= 0] * len(of) + at[at >= 0], return_counts=True)
            terms = pa.array(wanted, pa.string()).take(pa.array(key % len(of)))
            yield pa.RecordBatch.from_arrays([terms, b.column(0).take(pa.array(key // len(of))), pa.array(hits.astype(np.int64))], names=["term", "chunk_id", "hits"])

    return tokens.mapInArrow(run, "term string, chunk_id long, hits long") if wanted else tokens.sparkSession.createDataFrame([], "term string, chunk_id long, hits long")


#: Words of a vocabulary that is broadcast.
WORDS = 500_000


def stemmed_postings(index: DataFrame) -> DataFrame:
    """``postings`` by stem in place of term, without stopwords; the vocabulary is joined, not each occurrence stemmed.

    It is made once, and broadcast only where it is counted to have at most ``WORDS`` words.
    """
    shared_folder(index.sparkSession)
    known = stems(index).checkpoint()
    rows = index.join(F.broadcast(known) if known.count() <= WORDS else known, index.term == known.word)
    return rows.groupBy(F.col("stem").alias("term"), "chunk_id").agg(F.sum("tf").alias("tf"), F.sum("hits").alias("hits"))
