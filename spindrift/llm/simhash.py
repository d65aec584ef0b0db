"""SimHash near-duplicates: bit blocks bring fingerprints together, pivot distance tables discard pairs, survivors are verified."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, mapped, released, text_or_empty
from .components import connected_components, forest
from .tiles import dealt, tile_starts, whole_tiles

#: Production parameters: words in a shingle, seed of its XXH64, most differing bits of a link.
WORDS, SEED, BITS = 3, 42, 3
#: Bits of each block. Two of five blocks are equal in any pair that differs in 3 bits or fewer.
BLOCKS = (13, 13, 13, 13, 12)
#: Rows of a block of a large group, rows that a task works on at once, pivots.
TILE, FLUSH, PIVOTS = 2048, 150_000, 32
#: Reference fingerprints: evenly mixed words from a fixed generator.
_PIVOTS = np.random.default_rng(20_240_229).integers(0, 1 << 64, PIVOTS, dtype=np.uint64, endpoint=False)


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of the word shingles of ``text``, repeats included.

    ASCII letters are lower-cased; words are runs of bytes outside 0x20 and 0x09-0x0D. A text of
    fewer words is one shingle; one without words has fingerprint zero.
    """
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    digest, total, ones = xxhash.xxh64_intdigest, 0, np.zeros(64, dtype=np.int64)
    if len(w) < words:
        return digest(b" ".join(w), seed)
    last = len(w) - words + 1
    for at in range(0, last, 1 << 16):
        part = w[at : min(at + (1 << 16), last) + words - 1]
        h = np.array([digest(s, seed) for s in map(b" ".join, zip(*(part[k:] for k in range(words)), strict=False))], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(h)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, fp): digest is xxhash64 of the text, fp the fingerprint as a signed long. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t) for t in b.column(2).to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "digest", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("digest"), text_or_empty().alias("text"))
    return mapped(rows, run, "doc_id long, digest long, fp long")


def _near(a: np.ndarray, b: np.ndarray, fp: np.ndarray, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of candidate pairs (a, b) those within ``bits``; by the triangle inequality no coordinate of theirs differs by more."""
    for p in range(table.shape[1]):
        keep = np.abs(table[a, p] - table[b, p]) <= bits
        a, b = a[keep], b[keep]
        if p >= 3 and not len(a):
            break
    keep = np.bitwise_count(fp[a] ^ fp[b]) <= bits
    return a[keep], b[keep]


def tile_links(fp: np.ndarray, starts: np.ndarray, side: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked (i, j) of the rows of each tile, in bounded pieces.

    The distances to all pivots are computed once for a row. Within a tile rows are ordered by the
    distance to the first pivot, and only rows whose first coordinates are within ``bits`` become
    candidates at all.
    """
    if not len(fp):
        return
    table = np.bitwise_count(fp[:, None] ^ _PIVOTS[None, :]).astype(np.int8)
    tile = np.zeros(len(fp), dtype=np.int64)
    tile[starts] = 1
    tile = np.cumsum(tile)
    order = np.lexsort((table[:, 0], tile))
    rank = tile[order] * 128 + table[order, 0]
    end = np.searchsorted(rank, rank + bits, side="right")  # one past the last candidate, in order
    cross = np.zeros(tile[-1] + 1, dtype=bool)
    cross[tile[side == 1]] = True
    first, most = np.arange(len(fp)), 1 << 20
    span = end - first - 1
    cut = np.concatenate([[0], np.cumsum(span)])
    at = 0
    while at < len(fp):
        to = max(at + 1, int(np.searchsorted(cut, cut[at] + most, side="right")) - 1)
        n = span[at:to]
        a = np.repeat(first[at:to], n)
        b = a + 1 + np.arange(len(a)) - np.repeat(cut[at:to] - cut[at], n)
        a, b = order[a], order[b]
        valid = ~cross[tile[a]] | (side[a] != side[b])
        yield _near(a[valid], b[valid], fp, table, bits)
        at = to


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of ``fps(fp)``, whose components are those of all links.

    Each task returns a spanning forest of the links in its tiles rather than all of them.
    ``bits`` is 3 or fewer: the block keys are exact up to that.
    """
    if bits > 3:
        raise ValueError("two of five blocks are only certain to be equal at 3 bits or fewer")
    shifts, at = [], 0
    for size in BLOCKS:
        shifts.append((at, size))
        at += size
    block = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << n) - 1)) for s, n in shifts]
    keys = [F.shiftleft(F.lit(k).cast("long"), 26).bitwiseOR(F.shiftleft(block[i], 13)).bitwiseOR(block[j]) for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_tiles(batches, ["key"], FLUSH):
            own, back = np.unique(t.column("fp").to_numpy(), return_inverse=True)
            fp, side = own[back].view(np.uint64), t.column("side").to_numpy()
            root = forest(len(own), ((back[i], back[j]) for i, j in tile_links(fp, tile_starts(t, ["key"]), side, bits)))
            hooked = np.flatnonzero(root != np.arange(len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(own[hooked]), pa.array(own[root[hooked]])], names=["a", "b"])

    return mapped(dealt(rows, ["key"], "fp", TILE).select("key", "tile", "side", "fp"), run, "a long, b long")


def grouped(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, digest, fp, component (its least fingerprint), component_id."""
    fps = checkpointed(fingerprints(docs))
    own = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    linked = checkpointed(connected_components(links(own.select("fp"), bits)))
    placed = own.join(linked, own.fp == linked.node, "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    placed = checkpointed(placed)
    least = checkpointed(placed.groupBy("component").agg(F.min("least_id").alias("component_id")))
    named = checkpointed(placed.join(least, "component").select(F.col("fp").alias("_fp"), "component", "component_id"))
    return fps.join(named, fps.fp == F.col("_fp"), "left").drop("_fp")


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, ...)``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable by links of at most ``bits`` differing bits; equal
    fingerprints link, those of texts without words (zero) too. Null texts are empty; a null doc_id
    never names a component, one without any other id is null. Repeated rows give repeated rows; other
    columns are not read. An empty table gives no rows.
    """
    return grouped(docs, bits).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest doc_id (null ids last), then of the least xxhash64 of the text.

    All columns stay as they are, whatever their names; of rows that repeat both doc_id and text one stays.
    """
    return kept_of(docs, checkpointed(grouped(docs, bits).select("doc_id", "digest", "component")))


def kept_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the first row of each component of ``found(doc_id, digest, component)``, a checkpoint that goes with it, in the order of ``keep_one``."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")).alias("r")
    keep = found.groupBy("component").agg(first).select(F.col("r.doc_id").alias("kept_id"), F.col("r.digest").alias("kept_digest")).distinct()
    counts = found.groupBy("doc_id", "digest").count()
    keep = checkpointed(keep.join(counts, keep.kept_id.eqNullSafe(counts.doc_id) & (keep.kept_digest == counts.digest)).select("kept_id", "kept_digest", F.col("count").alias("rows")))
    released(found)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(text_or_empty()).alias("own_digest"))
    kept = rows.join(keep, (rows.own_digest == keep.kept_digest) & rows.own_id.eqNullSafe(keep.kept_id))
    if not keep.where("rows > 1").isEmpty():
        kept = kept.where("rows = 1").unionByName(kept.where("rows > 1").dropDuplicates(["own_id", "own_digest"]))
    return kept.select("row.*")
