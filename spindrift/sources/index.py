"""The stored index of chunks: postings by word and by stem, frequencies and the chunks by document. A question reads what it asks for alone.

It is written in segments, each a folder of every table: the first holds all chunks, a later one those of the documents that changed since, and which documents
these are. So it follows the data at the cost of what changed: rows of a document count from the last segment that has it, and numbers of
chunks are sums over segments. One small table names the segments that count, and is written last.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import german
from ..functions.text import folded_word, word_tokens
from ..operators import lexical
from ..operators.segment import document_of
from ..shipping import remove, shipped, tidied
from . import tables

#: Folders of each table; a cluster's store has thousands.
BUCKETS = 64
#: Segments from which an index should be compacted: a question reads some files of each.
SEGMENTS = 16
#: Changed documents that are told by a list or a broadcast; more are joined by a shuffle.
SMALL = 100_000
#: Changed documents whose chunks are found by their folders.
FEW = 1_000

#: A block: postings of one term. ``first`` is its least chunk, ``n`` their number, ``total`` the sum of hits. Those of stems have no tf and no size, which no score asks for.
_BLOCK = "term string, first long, n int, total long, ids array<long>, tf array<double>, hits array<int>, size array<int>"
_POSTINGS = f"{_BLOCK}, segment long, bucket int"
_FREQUENCY = "term string, kind string, ndoc long, segment long, bucket int"
_GONE = "document_id long, segment long"
_NAMED = "segment long, buckets int, count long, tokens long, gone long, schema string, state string, format int"
#: What the tables are like; an index of another format is none, and is written anew.
FORMAT = 2


@dataclass(frozen=True)
class Index:
    """Tables of one store and the two numbers that BM25 needs of all chunks; ``state`` is what the writer said of the data it holds."""

    postings: DataFrame
    stems: DataFrame
    frequency: DataFrame
    held: DataFrame
    count: int
    mean: float
    buckets: int
    segments: tuple[int, ...]
    state: str
    #: (document_id, last): the last segment that has a changed document; None where there is one segment.
    gone: DataFrame | None = field(default=None)
    few_gone: bool = True

    def alive(self, rows: DataFrame, document: Column | None = None) -> DataFrame:
        """``rows(segment, ...)`` of documents that no later segment has; ``document`` is their id, by default that of chunk_id."""
        if self.gone is None:
            return rows
        last = F.broadcast(self.gone) if self.few_gone else self.gone
        document = document_of(F.col("chunk_id")) if document is None else document
        marked = rows.withColumn("_document", document).join(last.withColumnRenamed("document_id", "_document"), "_document", "left")
        return marked.where("last is null or segment >= last").drop("_document", "last")

    @property
    def chunks(self) -> DataFrame:
        return self.alive(self.held, F.col("document_id")).drop("segment", "bucket")

    def of_terms(self, table: DataFrame, terms: Iterable[str]) -> DataFrame:
        """Rows of some terms: their folders and, as files are sorted, their row groups only. Frequencies come as sums over segments."""
        terms = sorted(set(terms))
        rows = table.where(F.col("bucket").isin(sorted({bucket_of(t.encode("utf-8", "surrogatepass"), self.buckets) for t in terms})) & F.col("term").isin(terms))
        if table is self.frequency:
            return rows.groupBy("term", "kind").agg(F.sum("ndoc").alias("ndoc")).where("ndoc > 0")
        return self.alive(rows).drop("segment", "bucket")

    def of_documents(self, ids: Iterable[int]) -> DataFrame:
        """Chunks of some documents."""
        ids = sorted(set(ids))
        rows = self.held.where(F.col("bucket").isin(sorted({bucket_of(k.to_bytes(8, "little", signed=True), self.buckets) for k in ids})) & F.col("document_id").isin(ids))
        return self.alive(rows, F.col("document_id")).drop("segment", "bucket")


def bucket_of(key: bytes, buckets: int) -> int:
    """The folder of a key, as ``_bucket`` has it: Spark's xxhash64 of a string's or a long's bytes."""
    h = xxhash.xxh64_intdigest(key, seed=42)
    return (h - (1 << 64) if h >> 63 else h) % buckets


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


#: What a task takes: bytes of texts that are cut into tokens, and postings that are sorted. Tables of more are dealt into more parts, so that no task grows with them.
TASK_TEXT, TASK_ROWS = 16 << 20, 1_000_000
#: Chunks are stored in files of so many times ``TASK_TEXT``, which are bounded too: if they make this many tasks, they are not dealt anew to be cut.
FILE = 8
#: Bytes of texts that a task cuts into rows of postings.
TASK_POSTED = 4 << 20
#: Tokens that a task groups by term at once, and postings of a block at most: a shuffle deals blocks by their number, so they must be alike.
TOKENS, BLOCK = 1 << 22, 256
_SHUFFLE = "spark.sql.shuffle.partitions"


def _parts(spark: SparkSession, amount: int, task: int) -> int:
    return max(1, int(spark.conf.get(_SHUFFLE)), -(-int(amount) // task))


@contextmanager
def _dealt(spark: SparkSession, parts: int) -> Iterator[None]:
    """What is written within is shuffled into so many parts, from which adaptive execution makes tasks of its size; the setting is restored."""
    before = spark.conf.get(_SHUFFLE)
    spark.conf.set(_SHUFFLE, str(parts))
    try:
        yield
    finally:
        spark.conf.set(_SHUFFLE, before)


def _text_bytes(chunks: DataFrame) -> int:
    return chunks.agg(F.coalesce(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in lexical.WEIGHTS), F.lit(0)).cast("long")), F.lit(0))).first()[0]


def text_parts(chunks: DataFrame) -> int:
    """How many parts hold the texts of chunks, so that a task cuts a bounded part of them."""
    return _parts(chunks.sparkSession, _text_bytes(chunks), TASK_POSTED)


def _put(df: DataFrame, folder: str, segment: int, by: str, order: list[str], buckets: int, parts: int) -> None:
    """A segment of a table in folders by a hash of ``by``, its files sorted. Rows are dealt by ranges into ``parts``, so that a term of very many chunks fills several tasks."""
    rows = df.withColumn("bucket", _bucket(F.col(by), buckets)).repartitionByRange(parts, "bucket", *order).sortWithinPartitions("bucket", *order)
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/segment={segment}")


def _grouped(code: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int) -> tuple[np.ndarray, ...]:
    """(code, row, tf, hits) of distinct (code, row), in order."""
    key = code * rows + row
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    return key[starts] // rows, key[starts] % rows, np.add.reduceat(weight[order], starts), np.diff(starts, append=len(key))


def _blocks(kind: str, names: list[str], code: np.ndarray, chunk: np.ndarray, hits: np.ndarray, tf: np.ndarray | None = None, size: np.ndarray | None = None) -> pa.RecordBatch:
    """Postings in the order of (code, chunk), as blocks of a term and ``BLOCK`` postings at most."""
    new = np.diff(code, prepend=-1) != 0
    place = np.arange(len(code)) - np.maximum.accumulate(np.where(new, np.arange(len(code)), 0))
    starts = np.flatnonzero(place % BLOCK == 0)
    ends = np.append(starts, len(code)).astype(np.int32)
    listed = lambda x, t: pa.nulls(len(starts), pa.list_(t)) if x is None else pa.ListArray.from_arrays(pa.array(ends), pa.array(x).cast(t))
    lists = [listed(chunk, pa.int64()), listed(tf, pa.float64()), listed(hits, pa.int32()), listed(size, pa.int32())]
    terms = pa.array(names, pa.string()).take(pa.array(code[starts]))
    own = [terms, pa.array(chunk[starts]), pa.array(np.diff(ends)), pa.array(np.add.reduceat(hits, starts).astype(np.int64)), *lists, pa.array([kind] * len(starts), pa.string())]
    return pa.RecordBatch.from_arrays(own, names=["term", "first", "n", "total", "ids", "tf", "hits", "size", "kind"])


def _named_codes(names: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Distinct names, and for each place its name's; -1 where there is none."""
    known = pa.array(names, pa.string()).dictionary_encode()
    return known.dictionary.to_pylist(), known.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def blocks_of(chunks: DataFrame, columns: dict[str, float] = lexical.WEIGHTS, parts: int | None = None) -> DataFrame:
    """Blocks of postings with ``kind``: folded words (``word``) and stems without stopwords (``stem``) of chunks, whose texts are cut into tokens once, in ``parts``.

    Words are counted where they are cut, so that no token is shuffled; each word is folded and stemmed once for ``TOKENS`` of them.
    """
    spark = shipped(chunks.sparkSession)
    stop, weights = german.stopwords_of(spark), [float(w) for w in columns.values()]

    def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).sort_by("chunk_id").combine_chunks()
        chunk = t.column(0).to_numpy()
        lists = [t.column(k + 1).combine_chunks() for k in range(len(weights))]
        lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
        lengths = [np.diff(x.offsets.to_numpy()) for x in lists]
        row = np.concatenate([np.repeat(np.arange(len(chunk)), n) for n in lengths])
        if not len(row):
            return
        weight = np.concatenate([np.full(int(n.sum()), w) for n, w in zip(lengths, weights, strict=True)])
        size = sum(lengths).astype(np.int64)
        words = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        own, code = words.dictionary.to_pylist(), words.indices.to_numpy().astype(np.int64)
        for kind, of in (("word", folded_word), ("stem", lambda w: None if w in stop else german.stem_of(w))):
            names, to = _named_codes([of(w) for w in own])
            at = to[code]
            kept = at >= 0
            if kept.any():
                c, r, tf, hits = _grouped(at[kept], row[kept], weight[kept], len(chunk))
                yield _blocks(kind, names, c, chunk[r], hits, *((tf, size[r]) if kind == "word" else ()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in batches:
            held.append(b)
            count += sum(b.column(k + 1).flatten().__len__() for k in range(len(weights)))
            if count >= TOKENS:
                yield from made(held)
                held, count = [], 0
        if held:
            yield from made(held)

    if parts and chunks.rdd.getNumPartitions() * FILE < parts:
        chunks = chunks.repartition(parts, "chunk_id")
    return chunks.select("chunk_id", *[word_tokens(F.col(c)) for c in columns]).mapInArrow(run, f"{_BLOCK}, kind string")


#: What a posting tells beside its term and chunk.
WORD, STEM = ("tf", "hits", "size"), ("hits",)


def _opened(blocks: DataFrame, told: tuple[str, ...], *more: str) -> DataFrame:
    """(term, chunk_id, what is told) of blocks: a row for each posting."""
    rows = blocks.select("term", *more, F.explode(F.arrays_zip("ids", *told)).alias("p"))
    return rows.select("term", F.col("p.ids").alias("chunk_id"), *[F.col(f"p.{c}").cast("double" if c == "tf" else "long").alias(c) for c in told], *more)


def _closed(rows: DataFrame, told: tuple[str, ...]) -> DataFrame:
    """Blocks of postings, made of the rows that lie together; as rows lie in the order of their terms, few are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b]).sort_by([("term", "ascending"), ("chunk_id", "ascending")])
                names, code = _named_codes(t.column("term").to_pylist())
                yield _blocks("", names, code, t.column("chunk_id").to_numpy(), **{c: t.column(c).to_numpy() for c in told})

    shipped(rows.sparkSession)
    return rows.select("term", "chunk_id", *told).mapInArrow(run, f"{_BLOCK}, kind string").drop("kind")


def terms_of(chunks: DataFrame, columns: dict[str, float] = lexical.WEIGHTS, parts: int | None = None) -> DataFrame:
    """(kind, term, chunk_id, size, tf, hits) of chunks, size and tf of words alone; with ``parts`` as the blocks that an index holds, made in so many tasks unless files do."""
    blocks = blocks_of(chunks, columns, parts)
    if parts:
        return blocks
    words, stems = _opened(blocks.where("kind = 'word'"), WORD, "kind"), _opened(blocks.where("kind = 'stem'"), STEM, "kind")
    return words.unionByName(stems, allowMissingColumns=True).select("kind", "term", "chunk_id", "size", "tf", "hits")


def _frequencies(words: DataFrame, stems: DataFrame, sign: int) -> DataFrame:
    """(term, kind, ndoc) of blocks, to be summed."""
    counted = [t.select("term", F.lit(kind).alias("kind"), (F.col("n") * sign).cast("long").alias("ndoc")) for t, kind in ((words, "word"), (stems, "stem"))]
    return counted[0].unionByName(counted[1])


def _segment(folder: str, number: int, chunks: DataFrame, former: DataFrame | None, buckets: int) -> tuple[int, int]:
    """Writes the tables of a segment: ``chunks`` come, ``former`` go. Returns by how much chunks and their tokens grow in number."""
    spark = chunks.sparkSession
    text = _text_bytes(chunks)
    _put(chunks, f"{folder}/chunks", number, "document_id", ["document_id", "position"], buckets, _parts(spark, text, FILE * TASK_TEXT))
    chunks = _rows(spark, folder, "chunks", _with_places(chunks.schema), [number]).drop("segment", "bucket")
    work = f"{folder}/work-{number}"
    try:
        terms_of(chunks, parts=_parts(spark, text, TASK_TEXT)).write.mode("overwrite").partitionBy("kind").parquet(f"{work}/new")
        schema = f"{_BLOCK}, kind string"
        both = spark.read.schema(schema).parquet(f"{work}/new")
        sums = both.where("kind = 'word'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
        parts, tokens = _parts(spark, sums["n"], TASK_ROWS), sums["total"]
        for name, kind in (("postings", "word"), ("stems", "stem")):
            _put(both.where(F.col("kind") == kind).drop("kind"), f"{folder}/{name}", number, "term", ["term", "first"], buckets, parts)
            remove(spark, f"{work}/new/kind={kind}")
        changes = _frequencies(_rows(spark, folder, "postings", _POSTINGS, [number]), _rows(spark, folder, "stems", _POSTINGS, [number]), 1)
        count = chunks.count()
        if former is not None:
            former.select("chunk_id", *lexical.WEIGHTS).write.mode("overwrite").parquet(f"{work}/former-chunks")
            before = spark.read.parquet(f"{work}/former-chunks")
            terms_of(before, parts=_parts(spark, _text_bytes(before), TASK_TEXT)).write.mode("overwrite").partitionBy("kind").parquet(f"{work}/former")
            old = spark.read.schema(schema).parquet(f"{work}/former")
            changes = changes.unionByName(_frequencies(old.where("kind = 'word'"), old.where("kind = 'stem'"), -1))
            count, tokens = count - before.count(), tokens - old.where("kind = 'word'").agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
        sums = changes.groupBy("term", "kind").agg(F.sum("ndoc").alias("ndoc")).where("ndoc <> 0")
        with _dealt(spark, parts):
            _put(sums, f"{folder}/lexeme_df", number, "term", ["term"], buckets, parts)
    finally:
        remove(spark, work)
    return count, tokens


def _named(spark: SparkSession, folder: str) -> list:
    known = tables.load(spark, f"{folder}/segments")
    return [] if known is None or "format" not in known.columns else sorted(known.where(F.col("format") == FORMAT).collect(), key=lambda r: r["segment"])


def _name(spark: SparkSession, folder: str, rows: list[tuple]) -> None:
    """From now on these segments count."""
    tables.replace(spark.createDataFrame([(*r[:7], FORMAT) for r in rows], _NAMED).coalesce(1), f"{folder}/segments")


def write(chunks: DataFrame, folder: str, buckets: int = BUCKETS, state: str = "") -> None:
    """Indexes ``chunks(chunk_id, document_id, position, text, redner, ...)`` whole, as one segment that takes the place of all others."""
    spark, known = chunks.sparkSession, _named(chunks.sparkSession, folder)
    number = known[-1]["segment"] + 1 if known else 0
    with tidied(spark):
        count, tokens = _segment(folder, number, chunks, None, buckets)
    _name(spark, folder, [(number, buckets, count, tokens, 0, chunks.schema.json(), state)])


def update(chunks: DataFrame, changed: DataFrame, folder: str, state: str = "") -> None:
    """A segment for the documents ``changed(document_id)``, of which ``chunks`` are all there are now; a document without chunks is gone.

    Reads the former chunks of these documents alone. A run that breaks off leaves the index as it was, and the next one writes the segment anew.
    """
    spark = chunks.sparkSession
    own, known = read(spark, folder), _named(spark, folder)
    number, buckets = known[-1]["segment"] + 1, known[0]["buckets"]
    ids = changed.select(F.col("document_id").cast("long").alias("document_id")).distinct()
    ids.write.mode("overwrite").parquet(f"{folder}/gone/segment={number}")
    ids = spark.read.schema("document_id long").parquet(f"{folder}/gone/segment={number}")
    gone = ids.count()
    if gone:
        few = [r[0] for r in ids.collect()] if gone <= FEW else []
        former = own.of_documents(few) if few else own.chunks.join(F.broadcast(ids) if gone <= SMALL else ids, "document_id", "left_semi")
        own_chunks = chunks.join(F.broadcast(ids) if gone <= SMALL else ids, "document_id", "left_semi").select(chunks.columns)
        with tidied(spark):
            count, tokens = _segment(folder, number, own_chunks, former, buckets)
        _name(spark, folder, [*map(tuple, known), (number, buckets, count, tokens, gone, known[0]["schema"], state)])
    else:
        _name(spark, folder, [*map(tuple, known[:-1]), (*tuple(known[-1])[:6], state)])


def compact(spark: SparkSession, folder: str) -> None:
    """One segment in place of several: rows that count are written together, no text is cut into tokens again."""
    own, known = read(spark, folder), _named(spark, folder)
    if own is None or len(known) == 1:
        return
    number, b = known[-1]["segment"] + 1, own.buckets
    _put(own.chunks, f"{folder}/chunks", number, "document_id", ["document_id", "position"], b, _parts(spark, _text_bytes(own.chunks), FILE * TASK_TEXT))
    for name, rows, told in (("postings", own.postings, WORD), ("stems", own.stems, STEM)):
        _put(_closed(own.alive(rows), told), f"{folder}/{name}", number, "term", ["term", "first"], b, _parts(spark, rows.count(), TASK_ROWS))
    sums = own.frequency.groupBy("term", "kind").agg(F.sum("ndoc").alias("ndoc")).where("ndoc > 0")
    _put(sums, f"{folder}/lexeme_df", number, "term", ["term"], b, _parts(spark, 0, TASK_ROWS))
    _name(spark, folder, [(number, b, sum(r["count"] for r in known), sum(r["tokens"] for r in known), 0, known[0]["schema"], known[-1]["state"])])


def sweep(spark: SparkSession, folder: str) -> list[int]:
    """Deletes the folders of segments before the first that counts, which ``write`` and ``compact`` leave for readers that still use them; returns their numbers."""
    first = min((r["segment"] for r in _named(spark, folder)), default=0)
    found = set()
    for table in ("chunks", "postings", "stems", "lexeme_df", "gone"):
        for name in tables.folders(spark, f"{folder}/{table}", "segment="):
            number = int(name.removeprefix("segment="))
            if number < first:
                remove(spark, f"{folder}/{table}/{name}")
                found.add(number)
    return sorted(found)


def _rows(spark: SparkSession, folder: str, table: str, schema: str | StructType, segments: Iterable[int]) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/{table}").where(F.col("segment").isin(list(segments)))


def _with_places(schema: StructType) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL("segment long, bucket int").fields])


def read(spark: SparkSession, folder: str) -> Index | None:
    """The index in a folder, or None. Its files are listed and its numbers read once for each version, which the last written table tells."""
    version = tables.current(spark, f"{folder}/segments")
    if not version:
        return None
    held = spark.__dict__.setdefault("_spindrift_indexes", {})
    known = held.get(folder)
    if known is None or known[0] != version:
        rows = _named(spark, folder)
        if not rows:
            return None
        segments, count, tokens = [r["segment"] for r in rows], sum(r["count"] for r in rows), sum(r["tokens"] for r in rows)
        found = [_rows(spark, folder, t, s, segments) for t, s in (("postings", _POSTINGS), ("stems", _POSTINGS), ("lexeme_df", _FREQUENCY), ("chunks", _with_places(StructType.fromJson(json.loads(rows[0]["schema"])))))]
        found[:2] = [_opened(t, told, "segment", "bucket") for t, told in zip(found[:2], (WORD, STEM), strict=True)]
        gone = _rows(spark, folder, "gone", _GONE, segments).groupBy("document_id").agg(F.max("segment").alias("last")) if len(rows) > 1 else None
        known = version, Index(*found, count, tokens / count if count else 0.0, rows[0]["buckets"], tuple(segments), rows[-1]["state"], gone, sum(r["gone"] for r in rows) <= SMALL)
        held[folder] = known
    return known[1]
