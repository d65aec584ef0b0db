"""Ranked lexical search for a set of items: postings in groups of equal impact, taken from the highest impact down, until bounds prove the best."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, mapped, table, text_or_empty

#: Documents of each item's answer.
TOP = 20
#: A block of items: so many of them and so many bytes of their texts at most (one item at least). Each block reads the documents once.
ITEMS, ITEM_BYTES = 5_000, 8 << 20
#: Documents and postings of which a task makes one set of lists; it makes one after the other.
SHARD_DOCS, SHARD_POSTINGS = 65_536, 4_000_000
#: Parts in which the answers of tasks are merged first.
MERGES = 64

#: Bytes of UTF-8 as terms have them: digits, letters (A-Z lower-cased) and whatever is not ASCII; all else parts terms.
_CLASSES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text in UTF-8, with repeats."""
    return text.encode("utf-8", "surrogatepass").translate(_CLASSES).split()


@dataclass(frozen=True)
class Block:
    """Some items: their ids, and their terms by number with how often each occurs."""

    ids: list
    numbers: dict[bytes, int]
    asked: list[tuple[np.ndarray, np.ndarray]]


def blocks(items: DataFrame, most: int = ITEMS, most_bytes: int = ITEM_BYTES) -> Iterator[Block]:
    """``items(item_id, text)`` in blocks of a bounded size; the driver holds one of them. Items without terms have no answer and are in none."""
    ids: list = []
    counts: list[Counter] = []
    held = 0

    def block() -> Block:
        numbers: dict[bytes, int] = {}
        asked = [(np.array([numbers.setdefault(t, len(numbers)) for t in c], dtype=np.int64), np.array(list(c.values()), dtype=np.int64)) for c in counts]
        return Block(list(ids), numbers, asked)

    for row in items.select("item_id", text_or_empty().alias("text")).toLocalIterator():
        found = Counter(terms(row["text"]))
        if not found:
            continue
        size = sum(map(len, found))
        if ids and (len(ids) >= most or held + size > most_bytes):
            yield block()
            ids, counts, held = [], [], 0
        ids.append(row["item_id"])
        counts.append(found)
        held += size
    if ids:
        yield block()


def forward(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, ids, tfs) of every document with a term: n terms with repeats, and those of ``numbers`` with how often they occur. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for b in batches:
            sizes, ends, ids, tfs, kept = [], [0], [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                found = terms(text)
                if not found:
                    continue
                kept.append(k)
                sizes.append(len(found))
                for t, tf in Counter(found).items():
                    number = get(t)
                    if number is not None:
                        ids.append(number)
                        tfs.append(tf)
                ends.append(len(ids))
            offsets = pa.array(ends, pa.int32())
            arrays = [b.column(0).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "ids", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return mapped(rows, run, "doc_id long, n long, ids array<int>, tfs array<long>")


class Shard:
    """The postings of some documents: by document, and for each term in groups of equal impact, the highest first."""

    def __init__(self, doc_ids: np.ndarray, missing: np.ndarray, ends: np.ndarray, ids: np.ndarray, impacts: np.ndarray, terms: int):
        self.doc_ids, self.missing, self.ends, self.ids, self.impacts = doc_ids, missing, ends, ids, impacts
        owner = np.repeat(np.arange(len(doc_ids), dtype=np.int32), np.diff(ends))
        order = np.lexsort((owner, -impacts, ids))
        self.docs, self.falling = owner[order], -impacts[order]
        self.lists = np.searchsorted(ids[order], np.arange(terms + 1))
        self.found = np.zeros(len(doc_ids), dtype=np.int64)
        self.weight = np.zeros(terms, dtype=np.int64)

    def complete(self, docs: np.ndarray, numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The whole scores of some documents, from their own postings."""
        sizes = self.ends[docs + 1] - self.ends[docs]
        # Every document here was met in a list, so none is without postings.
        firsts = np.cumsum(sizes) - sizes
        at = np.repeat(self.ends[docs] - firsts, sizes) + np.arange(sizes.sum())
        self.weight[numbers] = counts
        scores = np.add.reduceat(self.weight[self.ids[at]] * self.impacts[at], firsts) if len(docs) else np.zeros(0, dtype=np.int64)
        self.weight[numbers] = 0
        return scores

    def best(self, numbers: np.ndarray, counts: np.ndarray, limit: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, whole scores) of all that can be among the ``limit`` best and score ``least`` or more.

        Groups are taken from the highest impact down, a level (down to half of the highest impact that is left) at a time. What a document can still get is
        at most the sum of the highest impacts left in each list. Once that is below the score of the limit-th document so far, no document
        that was not met can be among the best; those met whose score so far and that sum reach it are completed from their own postings.
        """
        at, ends = self.lists[numbers].copy(), self.lists[numbers + 1]
        held = at < ends
        numbers, counts, at, ends = numbers[held], counts[held], at[held], ends[held]
        found, touched = self.found, []
        left = int((ends - at).sum())
        while left:
            heads = np.where(at < ends, -self.falling[np.minimum(at, len(self.falling) - 1)] * counts, 0)
            highest, rest = int(heads.max()), int(heads.sum())
            if touched:
                met = np.unique(np.concatenate(touched))
                touched = [met]
                so_far = found[met]
                bound = max(least, int(np.partition(so_far, len(met) - limit)[len(met) - limit]) if len(met) >= limit else 1)
                if rest < bound:
                    able = met[so_far + rest >= bound]
                    # To complete a document costs its own postings; where that is more than the lists still have, they are read on.
                    if highest == 0 or int((self.ends[able + 1] - self.ends[able]).sum()) <= left:
                        found[met] = 0
                        scores = self.complete(able, numbers, counts)
                        return able[scores >= bound], scores[scores >= bound]
            if highest == 0:
                break
            level = max(1, highest // 2)
            for k in np.flatnonzero(heads >= level):
                # The end of the last group whose impact, as often as the term is asked for, reaches the level.
                to = at[k] + np.searchsorted(self.falling[at[k] : ends[k]], -(-(-level // counts[k])), side="right")
                docs = self.docs[at[k] : to]
                found[docs] -= self.falling[at[k] : to] * counts[k]
                touched.append(docs)
                left -= int(to - at[k])
                at[k] = to
        if not touched:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        met = np.unique(np.concatenate(touched))
        scores = found[met]
        found[met] = 0
        held = scores >= max(least, 1)
        return met[held], scores[held]


def _kept(doc_ids: np.ndarray, missing: np.ndarray, scores: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((doc_ids, missing, -scores))[:limit]
    return doc_ids[order], missing[order], scores[order]


def _answers(rows: DataFrame, block: Block, weights: np.ndarray, count: int, length: int, limit: int) -> DataFrame:
    """(item, doc_id, score): each task's best documents of every item."""
    shared = rows.sparkSession.sparkContext.broadcast((block.asked, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, w = shared.value
        best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64))] * len(asked)

        def search(held: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            if not t.num_rows:
                return
            ids, tfs = (t.column(c).combine_chunks() for c in ("ids", "tfs"))
            sizes = np.asarray(ids.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            n, tf, number = (np.asarray(x.to_numpy(zero_copy_only=False), dtype=np.int64) for x in (t.column("n"), tfs.flatten(), ids.flatten()))
            m = 100 - 25 + (25 * n * count) // length
            impact = w[number] * ((1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, sizes)))
            doc_id = t.column("doc_id").combine_chunks()
            missing = np.asarray(doc_id.is_null().to_numpy(zero_copy_only=False), dtype=bool)
            shard = Shard(np.asarray(doc_id.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64), missing, np.append(0, np.cumsum(sizes)), number, impact, len(w))
            for k, (numbers, counts) in enumerate(asked):
                own_ids, own_missing, own_scores = best[k]
                docs, scores = shard.best(numbers, counts, limit, int(own_scores[-1]) if len(own_scores) >= limit else 1)
                if len(docs):
                    best[k] = _kept(np.append(own_ids, shard.doc_ids[docs]), np.append(own_missing, shard.missing[docs]), np.append(own_scores, scores), limit)

        held, docs, postings = [], 0, 0
        for b in batches:
            held.append(b)
            docs, postings = docs + b.num_rows, postings + len(b.column(2).flatten())
            if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                search(held)
                held, docs, postings = [], 0, 0
        if held:
            search(held)
        sizes = [len(b[0]) for b in best]
        if sum(sizes):
            ids, missing, scores = (np.concatenate([b[c] for b in best]) for c in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best), dtype=np.int32), sizes)), pa.array(ids, mask=missing), pa.array(scores)], names=["item", "doc_id", "score"])

    return mapped(rows, run, "item int, doc_id long, score long")


def weight(count: int, df: int) -> int:
    """A term's weight by the number of documents and of those that hold it."""
    return math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1)))


def ranked(docs: DataFrame, items: DataFrame, limit: int = TOP, most: int = ITEMS, most_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``limit`` best of all ``docs(doc_id, text)`` for each of ``items(item_id, text)``.

    Terms, weights and scores are those of the query's contract. Null and empty texts have no terms: such documents are not counted, such items
    have no rows. Each row is a document of its own, also where texts or ids repeat, and so is each row of the items; equal scores go by ascending
    doc_id, null ids last. Texts are read whole, however long. An empty table of either kind gives no rows; other columns are not read.
    Items come in blocks, each of which reads the documents once: a task cuts texts into terms and keeps those that the block asks for; the numbers of all
    documents are summed; then each task makes lists of its own documents, so that a term of very many documents is dealt over all of them,
    and gives its best for every item.
    """
    parts: list[DataFrame] = []
    for block in blocks(items, most, most_bytes):
        rows = checkpointed(forward(docs, block.numbers))
        total = rows.agg(F.count("*").alias("count"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        # A row for each term of the block at most.
        df = np.zeros(len(block.numbers), dtype=np.int64)
        for r in rows.select(F.explode("ids").alias("number")).groupBy("number").count().toLocalIterator():
            df[r["number"]] = r["count"]
        weights = np.array([weight(total["count"], int(x)) for x in df], dtype=np.int64)
        found = _answers(rows, block, weights, total["count"], max(1, total["length"]), limit).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGES)))
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        # Answers of all tasks are merged in parts first: an item's would else be as many as there are tasks.
        first = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= limit)
        last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= limit)
        names = docs.sparkSession.createDataFrame([(k, i) for k, i in enumerate(block.ids)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        parts.append(last.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return docs.sparkSession.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
QUERY_SQL = f"""
with items as (select item_id, row_number() over () as item, {_TERMS_SQL} as ts from benchmark),
asked as (select item, term, count(*) as q from (select item, unnest(ts) as term from items) group by all),
docs as (select doc_id, row_number() over () as d, {_TERMS_SQL} as ts from documents),
held as (select doc_id, d, len(ts) as n, ts from docs where len(ts) > 0),
total as (select count(*) as count, sum(n)::bigint as length from held),
postings as (select d, term, count(*) as tf from (select d, unnest(ts) as term from held) where term in (select term from asked) group by all),
weights as (select term, floor(1000 * ln((2 * max(count) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from postings, total group by term),
scores as (select item, d, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * count) // length))))::bigint as score
  from asked join postings using (term) join weights using (term) join held using (d), total group by item, d)
select item_id, (row_number() over (partition by item order by score desc, doc_id nulls last))::int as rank, doc_id, score
from scores join items using (item) join held using (d) where score > 0 qualify rank <= {TOP}"""
