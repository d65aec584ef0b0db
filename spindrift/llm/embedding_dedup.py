"""Embedding near-duplicates by products of int8 tiles with an error bound for every vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, mapped
from .components import connected_components, forest
from .tiles import dealt, tile_starts, whole_tiles

#: Production parameters: least cosine of a link, bytes of a block of a large label as float32, rows of one (None: by the bytes). A vector
#: goes to as many tiles as its label has blocks, so blocks are as large as a worker can hold well.
COSINE, TILE_BYTES, TILE = 0.93, 8 << 20, None
#: Rows of one side of a product, and dimensions summed at once: 127 * 127 * 1024 < 2^24, so float32 sums of int8 products are exact.
STRIP, EXACT_DIMS = 512, 1024


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows u of ``x``, codes q (int8 values), scales s and bounds e with ||u - s q|| <= e."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    s = np.abs(u).max(axis=1) / 127
    q = np.rint(u / s[:, None])
    e = np.sqrt(((u - s[:, None] * q) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
    return u, q.astype(np.int8), s, e


def strip_links(u, q, s, e, a: slice, b: slice, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of a, j of b) whose cosine in double precision is at least ``least``.

    u.v = s t q.r + rest with |rest| <= e ||v|| + ||s q|| f <= e + f (1 + e). Only pairs
    whose approximate product plus that bound reaches ``least`` are computed in full.
    """
    product = np.zeros((a.stop - a.start, b.stop - b.start))
    for d in range(0, q.shape[1], EXACT_DIMS):
        product += q[a, d : d + EXACT_DIMS].astype(np.float32) @ q[b, d : d + EXACT_DIMS].astype(np.float32).T
    product *= s[a, None] * s[None, b]
    product += e[a, None] + e[None, b] * (1 + e[a, None])
    i, j = np.nonzero(product >= least - 1e-9)
    keep = []
    for at in range(0, len(i), 1 << 16):
        i_, j_ = i[at : at + (1 << 16)] + a.start, j[at : at + (1 << 16)] + b.start
        keep.append((u[i_] * u[j_]).sum(axis=1) >= least)
    if not keep:
        return i, j
    keep = np.concatenate(keep)
    return i[keep] + a.start, j[keep] + b.start


def tile_pairs(x: np.ndarray, n0: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of a tile, each once. The first ``n0`` rows are side 0; if all are, pairs within count, else pairs across."""
    u, q, s, e = quantised(x)
    n = len(x)
    for at in range(0, n0, STRIP):
        a = slice(at, min(at + STRIP, n0))
        for to in range(at if n0 == n else n0, n, 4 * STRIP):
            b = slice(to, min(to + 4 * STRIP, n))
            i, j = strip_links(u, q, s, e, a, b, least)
            if n0 == n:
                up = i < j
                i, j = i[up], j[up]
            yield i, j


def near_duplicates(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors(vec_id, embedding, label)``.

    Rows link if their labels and dimensions are equal and the cosine is at least ``least``. A row with a
    null label, or a vector that is null, empty, zero or holds null or non-finite components,
    links with nothing and is its own component. n_links counts other rows, repeated ones too;
    component_id is the smallest vec_id of the component, null ids aside (null if it has no other).
    Other columns are not read. Equal vectors of a label are compared once, with their number.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    sound = F.coalesce(sound & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good, bad = v.where(sound), v.where(~sound)
    groups = good.groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least_id"))
    groups = checkpointed(groups.withColumn("gid", F.monotonically_increasing_id()))
    rows = groups.select(F.xxhash64("label", F.size("embedding")).alias("key"), F.col("label").cast("string").alias("name"), "gid", "n", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_tiles(batches, ["key"], 1):
            starts = [*tile_starts(t, ["key"]), t.num_rows]
            for at, to in zip(starts, starts[1:], strict=False):
                if to - at > 1:
                    yield one_tile(t.slice(at, to - at))

    def one_tile(t: pa.Table) -> pa.RecordBatch:
        side = t.column("side").to_numpy()
        order = np.argsort(side, kind="stable")
        gid, n = t.column("gid").to_numpy()[order], t.column("n").to_numpy()[order]
        # Labels or dimensions that share a hash are told apart here.
        kind = np.unique([f"{a}/{len(b)}" for a, b in zip(t.column("name").to_pylist(), t.column("embedding"), strict=True)], return_inverse=True)[1][order]
        degree, n0 = np.zeros(len(gid), dtype=np.int64), int((side == 0).sum())
        values = t.column("embedding").take(pa.array(order))

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for k in range(kind.max() + 1):
                own = np.flatnonzero(kind == k)
                x = np.array(values.take(pa.array(own)).combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(own), -1)
                for i, j in tile_pairs(x, int((own < n0).sum()), least):
                    i, j = own[i], own[j]
                    degree[:] += np.bincount(i, weights=n[j], minlength=len(gid)).astype(np.int64)
                    degree[:] += np.bincount(j, weights=n[i], minlength=len(gid)).astype(np.int64)
                    yield i, j

        root = forest(len(gid), pairs())
        hit = np.flatnonzero(degree)
        return pa.RecordBatch.from_arrays([pa.array(gid[hit]), pa.array(gid[root[hit]]), pa.array(degree[hit])], names=["a", "b", "degree"])

    dims = groups.agg(F.max(F.size("embedding"))).first()[0] or 1
    tiles = dealt(rows, ["key"], "gid", TILE or max(1024, TILE_BYTES // (4 * dims))).select("key", "tile", "side", "name", "gid", "n", "embedding")
    found = checkpointed(mapped(tiles, run, "a long, b long, degree long"))
    degrees = found.groupBy("a").agg(F.sum("degree").alias("degree"))
    linked = checkpointed(connected_components(found.select("a", "b")))
    placed = groups.drop("embedding", "label").join(linked, groups.gid == linked.node, "left")
    placed = checkpointed(placed.select("gid", "least_id", "n", F.coalesce("component", "gid").alias("component")))
    least_of = checkpointed(placed.groupBy("component").agg(F.min("least_id").alias("component_id")))
    placed = placed.join(least_of, "component").join(degrees, F.col("gid") == degrees.a, "left")
    placed = placed.select("gid", "component_id", (F.col("n") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"))
    named = groups.select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), "gid").join(placed, "gid").drop("gid")
    named = checkpointed(named)
    out = good.join(named, (good.label == named._label) & (good.embedding == named._embedding), "left").select("vec_id", "n_links", "component_id")
    lone = bad.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


QUERY_SQL = f"""
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e,
    sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as norm,
    label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 as sound
  from embeddings),
u as (select * from v where sound and norm > 0),
link as (
  select a.vec_id as a, b.vec_id as b from u a join u b
  on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  and list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) / (a.norm * b.norm) >= {COSINE}),
reach(a, b) as (select vec_id, vec_id from v union select r.a, l.b from reach r join link l on r.b = l.a),
c as (select a as vec_id, min(b) as component_id from reach group by a)
select c.vec_id, (select count(*) from link l where l.a = c.vec_id) as n_links, component_id, c.vec_id = component_id as kept from c"""
