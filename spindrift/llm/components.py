"""Connected components by alternating large-star and small-star steps; few links are contracted by one task.

Links stay distributed: a step is one aggregate and one equi-join, whose skewed keys
(the least node of a large component) adaptive execution splits, because both inputs of
each join are checkpoints that are shuffled for the join alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, mapped

#: Links (16 bytes each) up to which one task contracts them at once; the result is that of the steps.
SMALL = 1 << 20


def forest(n: int, pairs) -> np.ndarray:
    """The least member of each node's component for nodes 0..n-1.

    ``pairs`` yields (i, j) index arrays, so that links need not be held together.
    """
    parent = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = parent[i], parent[j]
            open_ = a != b
            i, j = i[open_], j[open_]
            a, b = a[open_], b[open_]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = parent[parent]
                if np.array_equal(up, parent):
                    break
                parent = up
    return parent


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def contracted(edges: DataFrame) -> DataFrame:
    """(node, component) of counted, few ``edges(u, v)``, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            u, v = (np.concatenate(x) for x in zip(*held, strict=True))
            nodes, back = np.unique(np.concatenate([u, v]), return_inverse=True)
            root = forest(len(nodes), [(back[: len(u)], back[len(u) :])])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])

    return mapped(edges.select("u", "v").coalesce(1), run, "node long, component long")


def connected_components(edges: DataFrame, max_rounds: int = 60, small: int | None = None) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the least node reachable.

    Edges are undirected longs; loops, nulls and repeats are allowed and say nothing
    (a node that has loops only is left out). No edges give no rows. Up to ``small`` links (``SMALL``) are
    counted and contracted in one task; more go by steps over all tasks, of which ``max_rounds`` settle any graph that fits
    into a cluster (their number grows with the logarithm of the longest path), else it is an error.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = checkpointed(e)
    sign = _signature(e)
    if sign[0] <= (SMALL if small is None else small):
        return contracted(e)
    for _ in range(max_rounds):
        if not sign[0]:
            break
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = checkpointed(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m")))
        large = checkpointed(e.join(low, e.v == low.x).select("u", F.col("m").alias("v")).where("u <> v").distinct())
        least = checkpointed(large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")))
        moved = large.join(least, large.u == least.x).select("u", "v", "m")
        small = moved.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        e = checkpointed(small.where("u <> v").distinct())
        now = _signature(e)
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # A settled graph is a set of stars: every non-least node points at its least node.
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
